"""Removal of byte strings that occur twice, by a distributed merge sort of suffixes.

A byte goes if a `width`-byte string over it also starts anywhere else, in any document.

1. Every document's windows pick anchors (`anchors.py`); contexts of anchors are counted over all
   documents. A window can only be repeated if its anchor's string is. A context that occurs twice as
   a whole is repeated in full.
2. Of the other contexts one copy each is taken. Their reversed left sides are merge sorted; the
   lengths that one shares with others are the only places where a match can begin.
3. The suffixes from these places are merge sorted; the longest prefix that a suffix shares with any
   other is how far its match goes.
4. The repeated windows go back to all copies of their contexts, and from them to documents.

Both sorts are those of `lcpsort.py`: front-coded runs, exchanged by range, combined by loser trees. Of the
different windows whose anchor recurs, 61 % are in contexts that go through them (0.1 GB of test documents,
12.4 of 20.4 million); the others are in contexts that only occur as exact copies.

Cases: a null text is an empty one; texts shorter than `width` lose nothing; repeated rows are places
of their own, so their texts go; rows may share doc_id; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TIE_BITS, as_rows, extended, keep, keyed_rows, pack_texts, schema_with, slices, table, unpack
from .lcpsort import longest_shared, shared_lengths
from .repeats import at, counted, places, tie

WIDTH = 400
GRAM = 64


def _contexts(width: int):
    """Text of each context: (core, context, string from its first window to the end of its last, what stands before the anchor reversed, place of the anchor, last window)."""

    def run(batches):
        for batch in slices(batches, 64):
            rows = {k: [] for k in ("core", "context", "text", "left", "at", "last")}
            for packed, chosen in zip(batch.column("packed").to_pylist(), batch.column("chosen").to_pylist()):
                raw = unpack(packed)
                for x in chosen:
                    rows["core"].append(x["core"])
                    rows["context"].append(x["context"])
                    rows["text"].append(raw[x["low"] : x["high"] + width])
                    # the core's hash in front: only contexts of one anchor share more than that
                    rows["left"].append(x["core"].to_bytes(8, "big", signed=True) + raw[x["low"] : x["at"]][::-1])
                    rows["at"].append(x["at"] - x["low"])
                    rows["last"].append(x["high"] - x["low"])
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("core", pa.int64()), ("context", pa.int64()), ("text", pa.binary()), ("left", pa.binary()), ("at", pa.int32()), ("last", pa.int32())]))

    return run


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs(doc_key, tie, text) -> (doc_key, tie, spans): runs [first, last] of starts of `width`-byte strings that start elsewhere too."""
    found = places(docs, width, gram, by_word=False)
    shared = keep(counted(found))
    whole = shared.where("n > 1").select("core", "context", (F.col("low") - F.col("at")).alias("from"), (F.col("high") - F.col("at")).alias("to"))

    chosen = shared.where("variants > 1").groupBy("doc_key", "tie").agg(F.collect_list(F.struct("core", "context", "at", "low", "high")).alias("chosen"))
    texts = keep(pack_texts(docs, "doc_key", "tie").join(chosen, ["doc_key", "tie"]).select("packed", "chosen").mapInArrow(_contexts(width), "core long, context long, text binary, left binary, at int, last int"))

    lengths = shared_lengths(texts.select(F.col("left").alias("string"), "core", "context", F.lit(0).alias("depth"), F.lit(0).alias("limit")), 8)
    begins = keep(texts.drop("left").join(lengths, ["core", "context"]))
    depth = begins.select("*", F.explode("depths").alias("depth")).where("at - depth <= last")
    suffixes = depth.select(F.expr("substring(text, at - depth + 1)").alias("string"), "core", "context", "depth", (F.col("last") - F.col("at")).alias("limit"))
    part = longest_shared(suffixes).where(F.col("shared") >= width).select("core", "context", (-F.col("depth")).alias("from"), F.least(F.col("shared") - F.col("depth") - width, F.col("limit")).alias("to"))

    windows = found.join(whole.unionByName(part), ["core", "context"]).select("doc_key", tie("place").alias("tie"), "from", "to", at("place").alias("at"))
    windows = windows.select("doc_key", "tie", F.struct((F.col("at") + F.col("from")).alias("first"), (F.col("at") + F.col("to")).alias("last")).alias("s"))
    return windows.groupBy("doc_key", "tie").agg(F.sort_array(F.collect_set("s")).alias("spans"))


_REMOVED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(width: int):
    def run(batches):
        for batch in slices(batches):
            sizes, removed, rest = [], [], []
            for packed, spans in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                raw, runs = unpack(packed), []
                for s in spans or ():
                    if runs and s["first"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s["last"] + width)
                    else:
                        runs.append({"start": s["first"], "end": s["last"] + width})
                cuts = [0, *(x for r in runs for x in (r["start"], r["end"])), len(raw)]
                sizes.append(len(raw))
                removed.append(runs)
                rest.append(b"".join(raw[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2)))
            gone = [n - len(x) for n, x in zip(sizes, rest)]
            yield extended(batch, 2, n_bytes=pa.array(sizes, pa.int64()), n_removed=pa.array(gone, pa.int64()), removed=pa.array(removed, _REMOVED), kept=pa.array(rest, pa.binary()))

    return run


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs(text, ...) -> (row, n_bytes, n_removed, removed, kept), one for each document.

    row: the document's other columns; removed: [start, end) of bytes; kept: the other bytes.
    """
    rows = keyed_rows(docs, TIE_BITS)
    spans = repeated_windows(rows, width, gram)
    done = pack_texts(rows, "row", "doc_key", "tie").join(spans, ["doc_key", "tie"], "left").select("row", "packed", "spans")
    return done.mapInArrow(_remove(width), schema_with(as_rows(docs), "n_bytes long", "n_removed long", "removed array<struct<start:long,end:long>>", "kept binary"))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], width: int = WIDTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by comparing all strings of a few small texts."""
    raw = {k: (v or "").encode() for k, v in texts.items()}
    seen: dict[bytes, int] = {}
    for b in raw.values():
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out
