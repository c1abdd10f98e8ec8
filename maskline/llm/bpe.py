"""Byte-level BPE by speculation: propose tokens, verify every adjacent pair, merge exactly only where that fails.

Ids are those of the vocabulary file under the tokenizers library without special tokens of a template: added
tokens are cut out of a text first, the rest is split into words by the byte-level pattern.

Speculate: at every byte of the words that are new to a task, the longest token that starts there is found by
one walk down a trie, for all bytes at once; a word's proposal goes from longest token to longest token. Verify: a
sequence of tokens is the encoding of its bytes if and only if each adjacent pair is the encoding of its
own bytes. For a pair (a, b) the parts of a that end at the boundary and the parts of b that start there are
known from the merges; undoing these in reverse order, the pair is compatible if no merge joins the two parts that
stand at the boundary before one of them is merged further. That is done for all different pairs at once.
Words with a pair that fails are merged in the order of the ranks, many words at once, a merge of each in a
round. A task keeps the words that it has met, up to a number of bytes; then it starts anew.

The proof needs merges whose parts come from earlier merges, as in every trained vocabulary; for a file in which
some do not, all words are merged exactly.

Cases: a null text is an empty one, without ids; rows are told apart by nothing and may repeat; a text of any
length is taken in whole, its words in turns; a word of any length is one word; carried columns may have any name but `text` and `ids`; an empty table
gives an empty result. Of bytes that are no UTF-8, decoding makes U+FFFD.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, schema_with, slices, table

# Fixed value: how byte-level vocabularies split a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that are looked up at once, and bytes of memory for words that a task remembers.
TURN_WORDS, KNOWN_BYTES = 1 << 16, 48 << 20
#: Bytes from which on a word is merged by itself, with a heap.
LONG_WORD = 64
#: Characters from which on a text's words come in turns.
LONG_TEXT = 1 << 21


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, the others count from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The tables of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        if found["normalizer"] or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in found["added_tokens"]):
            raise ValueError("normalizers, and added tokens that take white space or whole words only, are not supported")
        self.added = {x["content"]: x["id"] for x in found["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.words = regex.compile(PATTERN)
        byte = _byte_of()
        self.ids = {bytes(byte[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in self.added}
        self.size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, self.size)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self._read_merges(found["model"]["merges"], byte)
        self._read_trie()

    def _read_merges(self, merges: list, byte: dict[str, int]) -> None:
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        #: Rank of the merge that makes a token; what no merge makes is there from the start.
        self.made = np.full(self.size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        parts = [[self.ids[bytes(byte[c] for c in t)] for t in (m.split(" ") if isinstance(m, str) else m)] for m in merges]
        for rank, (a, b) in enumerate(parts):
            self.merges[a, b] = rank, self.ids[self.bytes[a] + self.bytes[b]]
        pairs = np.array(parts, np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.made_of = np.array([token for _, token in self.merges.values()], np.int64)  # by rank
        makers: dict[int, int] = {}
        for rank, token in self.merges.values():
            makers[token] = makers.get(token, 0) + 1
            if self.made[token] < 0:
                self.made[token] = rank
                self.left[token], self.right[token] = parts[rank]
        inner = np.flatnonzero(self.made >= 0)
        earlier = np.maximum(self.made[self.left[inner]], self.made[self.right[inner]]) < self.made[inner]
        self.trained = bool(earlier.all()) and max(makers.values(), default=1) == 1
        # tokens that are the encoding of their own bytes; others are never proposed
        self.own = np.zeros(self.size, bool)
        self.own[self.byte_ids] = True
        if self.trained:
            self.own[inner] = self.compatible(self.left[inner], self.right[inner], joined=True)
            for token in inner[np.argsort(self.made[inner])].tolist():
                self.own[token] &= self.own[self.left[token]] and self.own[self.right[token]]

    def _read_trie(self) -> None:
        edges: dict[int, int] = {}
        accepted = [-1]
        for token, i in self.ids.items():
            if self.own[i]:
                node = 0
                for b in token:
                    node = edges.setdefault(node << 8 | b, len(accepted))
                    if node == len(accepted):
                        accepted.append(-1)
                accepted[node] = i
        self.accepted = np.array(accepted, np.int32)
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.roots = np.array([edges[b] for b in range(256)], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a number above all ranks where there is none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], 1 << 62) if len(self.pair_keys) else np.full(len(keys), 1 << 62)

    def compatible(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether each pair of tokens stays apart when its bytes are encoded; joined: whether it does until it is merged itself."""
        ok = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        until = np.full(len(a), 1 << 61 if not joined else -1)  # first, nothing ends the two standing side by side
        while len(at):
            bad = self._rank(a, b) < until
            ok[at[bad]] = False
            # undo what was merged last; of equal merges the left one came first
            left = self.made[a] > self.made[b]
            whole = np.maximum(self.made[a], self.made[b]) < 0
            until = np.where(left, self.made[a], self.made[b] + 1)
            go = ~(bad | whole)
            a, b = np.where(left, self.right[a], a)[go], np.where(left, b, self.left[b])[go]
            at, until = at[go], until[go]
        return ok

    def longest(self, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, length) of the longest token from each byte on; end: where each byte's word ends."""
        node = self.roots[text]
        token, size = self.accepted[node].copy(), np.ones(len(text), np.int64)
        at = np.arange(len(text))
        depth = 1
        while len(at):
            inside = at + depth < end[at]
            at, node = at[inside], node[inside]
            keys = node << 8 | text[at + depth]
            to = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            there = self.edge_keys[to] == keys
            at, node = at[there], self.edge_to[to[there]]
            depth += 1
            found = self.accepted[node]
            good = found >= 0
            token[at[good]], size[at[good]] = found[good], depth
        return token, size

    def merged_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of words by their merges: in each round the lowest rank of a word, of equal ones the leftmost."""
        none = 1 << 62
        ids = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))

        def ranks(at: np.ndarray) -> np.ndarray:
            """Of the pairs that begin at these places."""
            to = np.minimum(at + 1, len(ids) - 1)
            return np.where((to > at) & (word[at] == word[to]), self._rank(ids[at], ids[to]), none)

        rank, done = ranks(np.arange(len(ids))), []
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(ids)))
            over = np.repeat(least == none, sizes)
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank = ids[~over], word[~over], rank[~over]
                least, sizes = least[least < none], sizes[least < none]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.append(True, word[at][1:] != word[at][:-1])[: len(at)]]
            ids[at] = self.made_of[least]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # each word before has lost one
            ids, word, rank = ids[stay], word[stay], rank[stay]
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near] = ranks(near) if len(near) else rank[near]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([w for w, _ in done]), np.concatenate([t for _, t in done])

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word by its merges, lowest rank first, of equal ones the leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(found[0], i) for i in range(n - 1) if (found := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            found = self.merges.get((ids[i], ids[j])) if j < n and ids[i] >= 0 else None
            if not found or found[0] != rank:
                continue  # one of the two has been merged with another
            ids[i], ids[j], after[i] = found[1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (found := self.merges.get((ids[k], ids[after[k]]))):
                    heapq.heappush(waiting, (found[0], k))
        return [i for i in ids if i >= 0]

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the greedy longest matches."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        token, size = self.longest(np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.repeat(ends, sizes))
        step, at, place = size.tolist(), 0, []
        while at < len(step):  # a token never runs over its word's end
            place.append(at)
            at += step[at]
        place = np.array(place, np.int64)
        return np.searchsorted(ends, place, "right"), token[place].astype(np.int64)

    def exactly(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token), the tokens of a word in order."""
        long = [i for i, w in enumerate(words) if len(w) >= LONG_WORD]
        found = [self.merged(words[i]) for i in long]
        short = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
        word, token = self.merged_together([words[i] for i in short])
        word = np.concatenate([np.array(short, np.int64)[word], np.repeat(np.array(long, np.int64), np.fromiter(map(len, found), np.int64, len(found)))])
        return word, np.concatenate([token, np.array([i for f in found for i in f], np.int64)])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of different words, one after the other, how many each has, and how many words were merged exactly."""
        failing = np.arange(len(words))
        word = token = np.zeros(0, np.int64)
        if self.trained:
            word, token = self.propose(words)
            next_to = np.flatnonzero(word[1:] == word[:-1])
            pairs, which = np.unique(token[next_to] << 32 | token[next_to + 1], return_inverse=True)
            ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            failing = np.unique(word[next_to[~ok[which]]])
        if len(failing):
            again, merged = self.exactly([words[i] for i in failing.tolist()])
            keep = ~np.isin(word, failing)
            word, token = np.concatenate([word[keep], failing[again]]), np.concatenate([token[keep], merged])
            order = np.argsort(word, kind="stable")
            word, token = word[order], token[order]
        return token.astype(np.int32), np.bincount(word, minlength=len(words)), len(failing)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Numbers(dict):
    """A number for each word, from 0 on, in the order of coming."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts; remembers the ids of words."""

    def __init__(self, path: str):
        self.file = vocabulary(path)
        self.exact = 0
        self.forget()

    def forget(self) -> None:
        """Know only the added tokens, which are words with one id."""
        self.numbers, self.size = _Numbers(), 0
        for token in self.file.added:
            self.numbers[token]  # noqa: B018
        self.ids = np.array(list(self.file.added.values()), np.int32)
        self.starts = np.arange(len(self.ids) + 1)

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text and the added tokens between them, in lists of bounded size."""
        for i, part in enumerate(self.file.cut.split(text) if self.file.cut else [text]):
            if i % 2:
                yield [part]
            elif len(part) < LONG_TEXT:
                yield self.file.words.findall(part)
            else:
                found = (m.group() for m in self.file.words.finditer(part))
                while turn := list(islice(found, TURN_WORDS)):
                    yield turn

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and where those of each begin, with the end."""
        if self.size > KNOWN_BYTES:
            self.forget()
        old = len(self.numbers)
        codes = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > old:
            new = [w.encode("utf-8", "replace") for w in islice(self.numbers, old, None)]
            ids, sizes, exact = self.file.encode_words(new)
            self.exact += exact
            self.size += sum(map(len, new)) + 120 * len(new)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        sizes = self.starts[codes + 1] - self.starts[codes]
        ends = np.append(0, np.cumsum(sizes))
        return self.ids[np.repeat(self.starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has."""
        out, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        whose: list[tuple[int, int]] = []  # text, and how many of the words that wait are its own

        def flush() -> None:
            ids, ends = self._ids(waiting)
            out.append(ids)
            at = 0
            for i, n in whose:
                sizes[i] += ends[at + n] - ends[at]
                at += n
            waiting.clear()
            whose.clear()

        for i, text in enumerate(texts):
            for words in self._words(text):
                waiting += words
                whose.append((i, len(words)))
                if len(waiting) >= TURN_WORDS:
                    flush()
        flush()
        return np.concatenate(out), sizes


def decode(ids: np.ndarray, sizes: np.ndarray, path: str) -> list[str]:
    """The texts of ids that stand one after the other, so many of each; ids that the file doesn't have count for nothing."""
    known = vocabulary(path)
    ids = np.asarray(ids, np.int64)
    there = (ids >= 0) & (ids < known.size)
    ids = np.where(there, ids, 0)
    n = np.where(there, known.sizes[ids], 0)
    ends = np.append(0, np.cumsum(n))
    raw = known.flat[np.repeat(known.places[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
    cuts = ends[np.append(0, np.cumsum(sizes))].tolist()
    return [raw[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:])]


def encode_documents(docs: DataFrame, *carry: str, path: str | None = None) -> DataFrame:
    """docs(carry, text) -> the carried columns and `ids`, the whole text's token ids."""
    path = path or default_vocabulary()

    def run(batches):
        encoder = Encoder(path)
        for batch in slices(batches):
            ids, sizes = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            yield extended(batch, 1, ids=pa.ListArray.from_arrays(ends, pa.array(ids)))

    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema_with(docs.select(*carry), "ids array<int>"))


def decode_documents(encoded: DataFrame, *carry: str, path: str | None = None) -> DataFrame:
    """encoded(carry, ids) -> the carried columns and `text`; null ids are none."""
    path = path or default_vocabulary()

    def run(batches):
        for batch in slices(batches):
            ids = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            yield extended(batch, 1, text=pa.array(decode(pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False), sizes, path), pa.string()))

    return encoded.select(*carry, "ids").mapInArrow(run, schema_with(encoded.select(*carry), "text string"))


def op12_bpe_codec(spark, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), "doc_id")
    told = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "ids")
    decoded = decode_documents(told, "doc_id", "n_tokens", "ids_sha256")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
