"""Packing of tokenized documents into sequences by bounded-space online best-fit.

Documents are tokenized where they are read. A document over the sequence length is cut; its first piece
takes what is left over, so all others are whole sequences and need no packing. The rest are dealt to
packers as lengths only. A packer keeps a fixed number of open bins; their free spaces are the bits of
one integer, so the fullest bin that a piece fits into is the lowest set bit at or above its length. When
a new bin would be one too many, the fullest closes first. Pieces come to a packer in a fixed order.

Cases: a null text is an empty one, which is the end token alone; rows may repeat or share doc_id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, table

LENGTH = 1024
END_ID = 2
#: Open bins of a packer, and pieces that a packer gets on average.
OPEN_BINS = 4096
PACKER_ROWS = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """The vocabulary file's byte-level BPE. Its ids stand in the order of its merges, so they serve as ranks.

    A text is cut at the file's added tokens, which have ids of their own, before anything else.
    """
    import public_tokenizers

    with open(vocabulary, encoding="utf-8") as f:
        found = json.load(f)
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in found["added_tokens"]):
        raise ValueError("added tokens that take white space or whole words only are not supported")
    added = {x["content"]: x["id"] for x in found["added_tokens"]}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None, vocabulary: str) -> np.ndarray:
    """Ids of a text as 32-bit numbers, then the end token."""
    return np.append(encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all"), np.uint32(END_ID)).astype("<u4")


def pieces(n: int, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than `length`."""
    first = (n - 1) % length + 1
    yield 0, first
    for start in range(first, n, length):
        yield start, length


def _tokenize(vocabulary: str, length: int):
    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = token_ids(text, vocabulary)
                for piece, (start, size) in enumerate(pieces(len(ids), length)):
                    out.append((doc_id, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())))
            found = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield found.astype({"doc_id": "Int64"})

    return run


class BestFit:
    """Bins of `size`, at most `open_bins` of them open; add() gives (bin, offset)."""

    def __init__(self, size: int = LENGTH, open_bins: int = OPEN_BINS):
        self.size, self.most, self.open, self.made = size, open_bins, 0, 0
        self.spaces = 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.spaces &= ~(1 << free)
        self.open -= 1
        return found

    def add(self, n: int) -> tuple[int, int]:
        fits = self.spaces >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            chosen = self._take(free)
        else:
            chosen, free = self.made, self.size
            self.made += 1
        left = free - n
        if left:
            if self.open == self.most:  # the fullest goes, be it the one at hand
                fullest = (self.spaces & -self.spaces).bit_length() - 1
                if fullest >= left:
                    return chosen, self.size - free
                self._take(fullest)
            self.bins[left].append(chosen)
            self.spaces |= 1 << left
            self.open += 1
        return chosen, self.size - free


def _pack(length: int, open_bins: int):
    def run(batches):
        first = TaskContext.get().partitionId() << 40
        bins = BestFit(length, open_bins)
        for pdf in batches:
            placed = [bins.add(n) for n in pdf["length"].tolist()]
            yield pdf.assign(sequence_id=[first + b for b, _ in placed], offset=[o for _, o in placed])

    return run


def _alone(batches):
    at = (1 << 62) + (TaskContext.get().partitionId() << 40)
    for pdf in batches:
        yield pdf.assign(sequence_id=np.arange(at, at + len(pdf)), offset=0)
        at += len(pdf)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = keep(docs.select("doc_id", "text").mapInPandas(_tokenize(vocabulary or default_vocabulary(), length), _PIECE))
    short = found.where(F.col("length") < length)
    packers = max(1, -(-short.count() // PACKER_ROWS))
    # sorted, so that a packer that runs again packs alike
    dealt = short.repartition(packers, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("doc_id", "ids_crc32", "length")
    schema = _PIECE + ", sequence_id long, offset long"
    return dealt.mapInPandas(_pack(length, open_bins), schema).unionByName(found.where(F.col("length") >= length).mapInPandas(_alone, schema))


def sequences(docs: DataFrame, layout: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The packed token ids: (sequence_id, ids). docs and layout must have distinct doc_ids."""
    path = vocabulary or default_vocabulary()
    cuts = layout.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("cuts"))

    def run(batches):
        for pdf in batches:
            out = []
            for text, found in zip(pdf["text"], pdf["cuts"]):
                ids = token_ids(text, path)
                out += [(c["sequence_id"], c["offset"], ids[c["start"] : c["start"] + c["length"]].astype(np.int32)) for c in found]
            yield pd.DataFrame(out, columns=["sequence_id", "offset", "ids"])

    parts = docs.select("doc_id", "text").join(cuts, "doc_id").select("text", "cuts").mapInPandas(run, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def best_fit_bound(lengths: Iterable[int], length: int = LENGTH) -> int:
    """Fewest sequences that these lengths could take."""
    return -(-sum(lengths) // length)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
