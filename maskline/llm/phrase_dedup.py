"""Removal of recurring passages with sharded Aho-Corasick automata.

A word goes if a window of `width` words over it also starts anywhere else, in any document.

1. Confirm. Every document's windows pick anchors (`anchors.py`); the contexts of anchors are counted over
   all documents. A context that occurs twice recurs as a whole. Where contexts differ but share their
   anchor, one copy of each gives its windows as rows, and those of which there are two recur.
2. Compile. Documents are dealt to blocks of about `BLOCK_BYTES` by their key. Of each context that holds a
   recurring passage, one place in each block is named, and the block takes the passage's words from it.
   They go into automata (pyahocorasick, a word being one symbol) of at most `SHARD_WORDS` words each.
3. Stream. All documents of the block are streamed through its automata, which find every occurrence,
   wherever in a document it is. The words that they cover go.

What is counted moves as rows of longs, summed on the map side; no key has to fit into one task. A task
holds the texts of one block and one automaton.

Cases: a null text has no words; documents under `width` words lose none; repeated rows are places of
their own; rows may share doc_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import span_hashes, word_hashes, words
from .common import TIE_BITS, as_rows, cut, keep, keyed_rows, pack_texts, schema_with, table, unpack
from .repeats import at, counted, places, tie

WIDTH = 35
GRAM = 6
#: Bytes of text that a block of documents has on average, and words that are compiled into one automaton.
BLOCK_BYTES = 1 << 20
SHARD_WORDS = 1 << 20


def _windows(width: int):
    """Every window of each chosen context: (core, window, context, first), first counted from the anchor."""

    def run(batches):
        for batch in batches:
            for packed, chosen in zip(batch.column("packed").to_pylist(), batch.column("chosen").to_pylist()):
                raw = np.frombuffer(unpack(packed), np.uint8)
                s, e, _ = words(raw, np.array([len(raw)]))
                low, high, anchor, core, context = (np.array([x[k] for x in chosen], np.int64) for k in ("low", "high", "at", "core", "context"))
                n = high - low + 1
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                window = span_hashes(word_hashes(raw, s, e), start, start + width).view(np.int64)
                yield pa.RecordBatch.from_pydict({"core": np.repeat(core, n), "window": window, "context": np.repeat(context, n), "first": (start - np.repeat(anchor, n)).astype(np.int16)})

    return run


def recurring(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """docs(doc_key, tie, text) -> places of anchors, and (core, context, firsts) of the contexts in which windows recur.

    firsts: where these windows begin, counted from the anchor.
    """
    found = places(docs, width, gram, by_word=True)
    contexts = keep(counted(found))
    whole = contexts.where("n > 1").select("core", "context", F.sequence(F.col("low") - F.col("at"), F.col("high") - F.col("at")).alias("firsts"))

    chosen = contexts.where("variants > 1").groupBy("doc_key", "tie").agg(F.collect_list(F.struct("core", "context", "at", "low", "high")).alias("chosen"))
    texts = pack_texts(docs, "doc_key", "tie").join(chosen, ["doc_key", "tie"]).select("packed", "chosen")
    rows = keep(texts.mapInArrow(_windows(width), "core long, window long, context long, first short"))
    twice = rows.groupBy("core", "window").agg(F.count("*").alias("n")).where("n > 1").select("core", "window")
    shared = rows.join(twice, ["core", "window"], "left_semi").join(contexts.where("n = 1 and variants > 1").select("core", "context"), ["core", "context"], "left_semi")
    # a context has fewer windows than `width`
    part = shared.groupBy("core", "context").agg(F.collect_set(F.col("first").cast("int")).alias("firsts"))
    held = cut(whole.unionByName(part))
    rows.unpersist()
    contexts.unpersist()
    return found, held


def passages(starts: list[int], width: int) -> list[tuple[int, int]]:
    """[start, end) of what windows at these starts cover, where they follow each other without a gap."""
    out: list[tuple[int, int]] = []
    for i in sorted(starts):
        if out and i == out[-1][1] - width + 1:
            out[-1] = out[-1][0], i + width
        else:
            out.append((i, i + width))
    return out


class Shard:
    """An automaton of passages, each at least `width` words; find() gives the windows of a text that are in one."""

    def __init__(self, phrases: list[list[bytes]], width: int):
        self.width, self.symbol = width, {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase in phrases:
            for w in phrase:
                if w not in self.symbol:
                    n = len(self.symbol) + 1
                    self.symbol[w] = chr(n if n < 0xD800 else n + 0x800)
            self.automaton.add_word("".join(map(self.symbol.__getitem__, phrase)), len(phrase))
        self.automaton.make_automaton()

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """[first, last] windows of each occurrence."""
        known = self.symbol.get
        for end, size in self.automaton.iter("".join([known(w, "\0") for w in text])):
            yield end - size + 1, end - self.width + 1


def _shards(phrases: dict[tuple, None], width: int) -> Iterator[Shard]:
    part, size = [], 0
    for phrase in phrases:
        if part and size + len(phrase) > SHARD_WORDS:
            yield Shard(part, width)
            part, size = [], 0
        part.append(phrase)
        size += len(phrase)
    if part:
        yield Shard(part, width)


def occurrences(texts: list[list[bytes]], phrases: dict[tuple, None], width: int) -> list[list[tuple[int, int]]]:
    """For each text, [start, end) of the words that occurrences of the phrases cover."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for shard in _shards(phrases, width):
        for own, text in zip(found, texts):
            if len(text) >= width:
                own.extend(shard.find(text))
    out = []
    for own in found:
        covered: list[tuple[int, int]] = []
        for first, last in sorted(own):
            if covered and first <= covered[-1][1]:
                covered[-1] = covered[-1][0], max(covered[-1][1], last + width)
            else:
                covered.append((first, last + width))
        out.append(covered)
    return out


_REMOVED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _stream(width: int, tidy: bool):
    """Rows sorted by block, then document: named places of passages come before the document that they are in."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = [(p, p.filter(p.column("packed").is_valid())) for p in parts]
        texts = [unpack(x) for _, d in own for x in d.column("packed").to_pylist()]
        split = [t.split() for t in texts]
        first: dict[tuple[int, int], int] = {}
        for i, key in enumerate(k for _, d in own for k in zip(d.column("doc_key").to_pylist(), d.column("tie").to_pylist())):
            first.setdefault(key, i)
        phrases: dict[tuple, None] = {}
        for p, _ in own:
            named = p.filter(p.column("packed").is_null())
            for key, tie_, anchor, firsts in zip(*(named.column(c).to_pylist() for c in ("doc_key", "tie", "anchor", "firsts"))):
                source = split[first[key, tie_]]
                for start, end in passages(firsts, width):
                    phrases[tuple(source[anchor + start : anchor + end])] = None
        n_removed, kept = [], []
        removed = occurrences(split, phrases, width)
        for raw, text, gone in zip(texts, split, removed):
            cuts = [0, *(x for span in gone for x in span), len(text)]
            rest = [w for i in range(0, len(cuts), 2) for w in text[cuts[i] : cuts[i + 1]]] if gone else text
            n_removed.append(len(text) - len(rest))
            kept.append(b" ".join(rest) if gone or tidy else raw)
        rows = pa.concat_arrays([d.column("row") for _, d in own])
        spans = pa.array([[{"start": a, "end": b} for a, b in gone] for gone in removed], _REMOVED)
        return pa.RecordBatch.from_arrays([rows, pa.array([len(t) for t in split], pa.int64()), pa.array(n_removed, pa.int64()), spans, pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "removed", "kept"])

    def run(batches):
        parts, number = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(cuts, cuts[1:]):
                if parts and blocks[i] != number:
                    yield block(parts)
                    parts = []
                number = blocks[i]
                parts.append(batch.slice(i, j - i))
        if parts:
            yield block(parts)

    return run


def dedup_phrases(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, tidy: bool = True) -> DataFrame:
    """docs(text, ...) -> (row, n_words, n_removed, removed, kept), one for each document.

    row: the document's other columns; removed: [start, end) of words; kept: the other words, joined by one space. Where
    tidy is off, a text that loses nothing stays as it is.
    """
    rows = keyed_rows(docs, TIE_BITS)
    found, held = recurring(rows, width, gram)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).head().n or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_key", "tie"), F.lit(blocks)).alias("block")

    # one place of each context in each block, taken before the join: a frequent context joins once for each block
    named = found.select("core", "context", "doc_key", tie("place").alias("tie"), at("place").alias("anchor")).select("*", block)
    named = named.groupBy("block", "core", "context").agg(F.min(F.struct("doc_key", "tie", "anchor")).alias("p")).join(held, ["core", "context"])
    texts = pack_texts(rows, "row", "doc_key", "tie")
    none = lambda name: F.lit(None).cast(texts.schema[name].dataType).alias(name)
    named = named.select("block", "p.doc_key", "p.tie", "p.anchor", "firsts", none("row"), none("packed"))
    texts = texts.select(block, "doc_key", "tie", F.lit(None).cast("int").alias("anchor"), F.lit(None).cast("array<int>").alias("firsts"), "row", "packed")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.unionByName(texts).repartition(n, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(_stream(width, tidy), schema_with(as_rows(docs), "n_words long", "n_removed long", "removed array<struct<start:long,end:long>>", "kept string"))


def op9_phrase_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], width: int = WIDTH) -> dict[int, tuple[int, int, str]]:
    """The same by comparing all windows of a few small texts."""
    split = {k: (v or "").encode().split() for k, v in texts.items()}
    seen = Counter(tuple(w[i : i + width]) for w in split.values() for i in range(len(w) - width + 1))
    out = {}
    for k, w in split.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[k] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out
