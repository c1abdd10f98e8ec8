"""Benchmark decontamination by size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number of distinct five-word shingles, into classes by powers of two. A
MinHash of a whole long document says little about a short item, so every document is looked at in windows
of the class's size: blocks of as many shingles as the class's largest item has, two neighbouring blocks
being a window. An item contained in the document then makes up a good part of some window, and the minima
of enough hash functions meet (one row a band: a met minimum is a shared shingle). By formula an item
contained at `CONTAINMENT` in one window shares a fifth of the union with it at least, and no minimum of 96
with a chance below 1e-9.

A minimum that can meet is the hash of a shingle that some item has. So a bitmap of the items' shingles goes
to all tasks, and only windows with a shingle in it are hashed; a document without any gives no row. The
bitmap has at most `BITMAP_BITS` bits, however large the benchmark is: if it gets full, more windows are
hashed, and the result is the same. Minima of windows meet those of items in a join on rows of longs, in which frequent
minima are dealt to many parts; pairs that
meet are verified on the shingles themselves: the share of the item's distinct shingles that the whole
document has. Documents are read once, whatever the number of items.

Cases: words are lower-cased in A-Z; a text of under five words is one shingle, its words; a text without
words has none and neither matches nor is matched; null is empty; equal items each give their row, as do
rows that repeat or share doc_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import raw_bytes, span_hashes, word_hashes, words
from .common import as_rows, hot_join, keep, keyed_rows, row_keys, schema_with, table, text_blocks, unkeyed

SHINGLE = 5
CONTAINMENT = 0.8
#: Hash functions, at most 128.
HASHES = 96
#: Bits of the bitmap for each shingle, and at most; bits that a shingle sets.
SHINGLE_BITS, BITMAP_BITS, SET_BITS = 64, 1 << 29, 4

_U = np.uint64


def _lower(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def text_shingles(text: str | None, k: int = SHINGLE) -> set[bytes]:
    """Distinct shingles of a text, exactly."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def shingle_hashes(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of every shingle, in order."""
    raw, ends = raw_bytes(texts)
    raw = _lower(raw)
    s, e, upto = words(raw, ends)
    h = word_hashes(raw, s, e)
    first = np.concatenate([[0], upto[:-1]])
    n = upto - first
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    doc = np.repeat(np.arange(len(ends)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    return doc, span_hashes(h, start, np.minimum(start + k, upto[doc])) if len(start) else np.zeros(0, _U)


def _families() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _folded(h: np.ndarray) -> np.ndarray:
    return (h >> _U(32)).astype(np.uint32)


def _hashed(x: np.ndarray, a: np.uint32, b: np.uint32) -> np.ndarray:
    y = x * a + b
    return (y ^ (y >> np.uint32(16))) * np.uint32(0x45D9F3B)


def _meeting(size: np.ndarray | int, f: int, minimum: np.ndarray) -> np.ndarray:
    """One number for a class, a function and a minimum."""
    return (np.int64(int(size).bit_length()) << 39) | (np.int64(f) << 32) | minimum.astype(np.int64)


def _places(h: np.ndarray, bits: int):
    """The bits of each hash, one array after another."""
    step = (h >> _U(17)) | _U(1)
    for i in range(SET_BITS):
        yield ((h + _U(i) * step) * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)


def in_bitmap(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes of which all bits are set."""
    left = np.arange(len(h))
    for i in range(SET_BITS):
        at = next(p for k, p in enumerate(_places(h[left], bits)) if k == i)
        left = left[(bitmap[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1]
    return left


def _item_rows(batches):
    """(key, tie, text) of items -> their class, distinct shingles and minima as meeting numbers."""
    a, b = _families()
    for batch in batches:
        out = {k: [] for k in ("key", "tie", "shingles", "meets")}
        for key, tie, text in zip(*(batch.column(c).to_pylist() for c in ("key", "tie", "text"))):
            _, h = shingle_hashes(pa.array([text], pa.string()))
            if not len(h):
                continue
            size, x = 1 << int(len(np.unique(h)) - 1).bit_length(), _folded(h)
            out["key"].append(key)
            out["tie"].append(tie)
            out["shingles"].append(sorted(s.decode("utf-8", "surrogatepass") for s in text_shingles(text)))
            out["meets"].append([int(_meeting(size, f, _hashed(x, a[f], b[f]).min())) for f in range(HASHES)])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("tie", pa.int64()), ("shingles", pa.list_(pa.string())), ("meets", pa.list_(pa.int64()))]))


def _bitmap(own: DataFrame) -> tuple[Broadcast, int, list[int]]:
    """The bitmap of all items' shingles, its size in powers of two, and the classes that there are; tasks send bits, not shingles."""
    count = own.agg(F.sum(F.size("shingles")).alias("n"), F.collect_set(F.shiftright(F.col("meets")[0], 39)).alias("c")).head()
    bits = min(BITMAP_BITS, max(1 << 16, SHINGLE_BITS * (count.n or 0)) - 1).bit_length()

    def run(batches):
        for batch in batches:
            texts = pa.concat_arrays([batch.column(0).flatten()]) if batch.num_rows else pa.array([], pa.string())
            _, h = shingle_hashes(texts)
            at = np.unique(np.concatenate([np.zeros(0, _U), *_places(h, bits)])).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"at": pa.array([at.tobytes()], pa.binary())})

    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for r in own.select("shingles").mapInArrow(run, "at binary").toLocalIterator():
        at = np.frombuffer(r["at"], np.uint32)
        np.bitwise_or.at(bitmap, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return own.sparkSession.sparkContext.broadcast(bitmap), bits, [1 << (c - 1) for c in sorted(count.c)]


def window_minima(doc: np.ndarray, h: np.ndarray, hit: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(document, meeting number) of the minima that are hashes of hits, in all windows with a hit.

    h: shingle hashes of documents one after another; doc: their documents; hit: indices of those in the bitmap.
    """
    begin = np.searchsorted(doc, doc[hit], "left")
    stop = np.searchsorted(doc, doc[hit], "right")
    is_hit, x, (a, b) = np.zeros(len(h), bool), _folded(h), _families()
    is_hit[hit] = True
    docs, meets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in sizes:
        block = begin + (hit - begin) // size * size
        low = np.concatenate([block, np.maximum(block - size, begin)])
        low, pick = np.unique(low, return_index=True)
        end = np.minimum(low + 2 * size, np.tile(stop, 2)[pick])
        n = end - low
        cut = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(cut, n) + np.repeat(low, n)
        xs, own = x[at], is_hit[at]
        for f in range(HASHES):
            v = _hashed(xs, a[f], b[f])
            least = np.minimum.reduceat(v, cut)
            met = np.flatnonzero(np.logical_or.reduceat(own & (v == np.repeat(least, n)), cut))
            docs.append(doc[low[met]])
            meets.append(_meeting(size, f, least[met]))
    pairs = np.unique(np.column_stack([np.concatenate(docs), np.concatenate(meets)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _document_rows(given: Broadcast, bits: int, sizes: list[int]):
    """(row, doc_key, tie, text) -> those that have shingles in the bitmap, with these and with the meeting numbers of their windows."""

    def run(batches):
        for batch in batches:
            for first, texts in text_blocks(batch.column("text")):
                doc, h = shingle_hashes(texts)
                hit = in_bitmap(given.value, bits, h)
                if not len(hit):
                    continue
                whole, meets = window_minima(doc, h, hit, sizes)
                rows, shingles, numbers = np.unique(whole), [], []
                for i in rows.tolist():
                    w = texts[i].as_py().encode("utf-8", "surrogatepass").lower().split()
                    start = np.searchsorted(doc, i)
                    own = {b" ".join(w[k : k + SHINGLE]) for k in (hit[np.searchsorted(doc[hit], i) : np.searchsorted(doc[hit], i, "right")] - start).tolist()}
                    shingles.append([s.decode("utf-8", "surrogatepass") for s in own])
                    numbers.append(meets[whole == i])
                out = batch.select(["row", "doc_key", "tie"]).take(pa.array(first + rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shingles, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int64()))], names=["row", "doc_key", "tie", "hits", "meets"])

    return run


def _matched(rows: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """rows(row, text, doc_key, tie), items(text, ...) -> (row, doc_key, tie, item, containment), item being a row of items without its text."""
    given = as_rows(items, F.coalesce("text", F.lit("")).alias("text")).select("row", "text", *[c.alias(n) for c, n in zip(row_keys("text"), ("key", "tie"))])
    own = keep(given.select("key", "tie", "text").distinct().mapInArrow(_item_rows, "key long, tie long, shingles array<string>, meets array<long>"))
    bitmap, bits, sizes = _bitmap(own)
    held = keep(rows.mapInArrow(_document_rows(bitmap, bits, sizes), schema_with(rows.select("row", "doc_key", "tie"), "hits array<string>", "meets array<long>")))

    left = held.select("doc_key", "tie", F.explode("meets").alias("meet")).distinct()
    right = own.select("key", F.col("tie").alias("key_tie"), F.explode("meets").alias("meet"))
    pairs = hot_join(keep(left), right, "meet", "doc_key").select("doc_key", "tie", "key", "key_tie").distinct()
    named = given.select(F.col("row").alias("item"), "key", F.col("tie").alias("key_tie"))
    share = F.size(F.array_intersect("hits", "shingles")) / F.size("shingles")
    both = pairs.join(held.drop("meets"), ["doc_key", "tie"]).join(own.select("key", F.col("tie").alias("key_tie"), "shingles"), ["key", "key_tie"])
    return both.withColumn("containment", share).where(F.col("containment") >= least).join(named, ["key", "key_tie"]).select("row", "doc_key", "tie", "item", "containment")


def contained(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """docs(text, ...), items(text, ...) -> (row, item, containment) of all pairs with at least this containment; row and item: the other columns."""
    return _matched(keyed_rows(docs), items, least).select("row", "item", "containment")


def without_leaks(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """The documents that contain no item, unchanged."""
    rows = keyed_rows(docs)
    leaks = keep(_matched(rows, items, least).select("doc_key", "tie").distinct())
    return unkeyed(rows.join(leaks, ["doc_key", "tie"], "left_anti"), docs)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, containment) of every benchmark item of which a document has at least 0.8."""
    found = contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("row.doc_id", "item.item_id", "containment")


def brute_force(docs: pd.DataFrame, items: pd.DataFrame, least: float = CONTAINMENT) -> set[tuple[int, int, float]]:
    """The same by comparing all pairs of small tables."""
    own = [(i, text_shingles(t)) for i, t in zip(items["item_id"], items["text"])]
    out = set()
    for d, t in zip(docs["doc_id"], docs["text"]):
        have = text_shingles(t)
        out |= {(d, i, len(s & have) / len(s)) for i, s in own if s and len(s & have) >= least * len(s)}
    return out
