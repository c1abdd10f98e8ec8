"""What finding repeated bytes and repeated words share: counting contexts of anchors over all documents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, byte_symbols, context_hashes, raw_bytes, word_hashes, words
from .common import BLOCK_BYTES, TIE_BITS, keep, text_blocks

#: Symbols that are looked at together; more than a block of several documents has.
PART = 1 << 22

_SCHEMA = "doc_key long, place long, core long, context long"


#: A place is one long: the row's tie, the first window that picks the anchor (31 bits), and how far after it
#: the anchor and the last such window are (10 bits each).
_LOW_BITS = 63 - TIE_BITS - 20


def tie(place: str | Column) -> Column:
    """The second key of the row."""
    return F.shiftright(place, 20 + _LOW_BITS)


def low(place: str | Column) -> Column:
    """First window that picks the anchor."""
    return F.shiftright(place, 20).bitwiseAND(F.lit((1 << _LOW_BITS) - 1)).cast("int")


def at(place: str | Column) -> Column:
    """The anchor."""
    return (low(place) + F.shiftright(place, 10).bitwiseAND(F.lit(1023))).cast("int")


def high(place: str | Column) -> Column:
    """Last window that picks the anchor."""
    return (low(place) + F.shiftright(place, 0).bitwiseAND(F.lit(1023))).cast("int")


def _parts(symbols: np.ndarray, ends: np.ndarray, width: int, size: int):
    """(first document, its start, symbols skipped, symbols, ends) of a block; a very long block comes in overlapping parts.

    Every window is in one part. An anchor at a seam has two contexts, which only share a core.
    """
    if len(symbols) <= size:
        yield 0, 0, 0, symbols, ends
        return
    for doc, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        for skip in range(start, end - width + 1, size):
            own = symbols[skip : min(skip + size + width - 1, end)]
            yield doc, start, skip, own, np.array([len(own)])


def _places(width: int, gram: int, by_word: bool, part: int, block: int, cores_only: bool = False) -> Callable:
    def run(batches):
        for batch in batches:
            keys, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, texts in text_blocks(batch.column(2), block):
                raw, ends = raw_bytes(texts)
                if by_word:
                    s, e, ends = words(raw, ends)
                    symbols = plain = word_hashes(raw, s, e)
                else:
                    symbols, plain = byte_symbols(raw), raw
                for doc, start, skip, own, stops in _parts(symbols, ends, width, part):
                    found = anchors(own, stops, width, gram)
                    if cores_only:
                        yield pa.RecordBatch.from_pydict({"core": found["core"].view(np.int64)})
                        continue
                    base = np.concatenate([[0], stops[:-1]])[found["doc"]] - (skip - start) if len(stops) else found["doc"]
                    contexts = context_hashes(plain[skip : skip + len(own)], found["low"], found["high"] + width)
                    row = first + doc + found["doc"]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_key": keys[row],
                            "place": ties[row] << 20 + _LOW_BITS | (found["low"] - base) << 20 | (found["at"] - found["low"]) << 10 | (found["high"] - found["low"]),
                            "core": found["core"].view(np.int64),
                            "context": contexts.view(np.int64),
                        }
                    )

    return run


def _apart(by_core: DataFrame) -> DataFrame:
    """A small table of cores in a stage of its own, so that the join's other side can be split where it is skewed."""
    return by_core.repartition(int(by_core.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def places(docs: DataFrame, width: int, gram: int, by_word: bool) -> DataFrame:
    """(doc_key, place, core, context) of the anchors of docs(doc_key, tie, text) whose string recurs.

    place is read with `tie`, `low`, `at` and `high`, which count from the document's start. core names the
    anchor's string and context, with core, the symbols of all windows that pick it.

    How often a core occurs is summed on the map side first, so a core in a third of all rows moves as
    one row for each task; the join that keeps the recurring ones is one that Spark splits where it is
    skewed.
    """
    if width - gram >= 1 << 10:
        raise ValueError("a place has 10 bits for what follows the first window")
    texts = docs.select("doc_key", "tie", "text")
    # finding the places twice takes less than keeping all of them, most of which never recur
    cores = texts.mapInArrow(_places(width, gram, by_word, PART, BLOCK_BYTES, cores_only=True), "core long")
    again = _apart(cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    return keep(texts.mapInArrow(_places(width, gram, by_word, PART, BLOCK_BYTES), _SCHEMA).join(again, "core", "left_semi"))


def counted(found: DataFrame) -> DataFrame:
    """Different contexts: how often each occurs, how many share its core, and one place of each.

    Counts are summed on the map side first here too.
    """
    by_context = found.groupBy("core", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_key", "place")).alias("p"))
    by_core = _apart(found.groupBy("core", "context").agg(F.lit(1)).groupBy("core").agg(F.count("*").alias("variants")))
    return by_context.join(by_core, "core").select("core", "context", "n", "variants", "p.doc_key", tie("p.place").alias("tie"), low("p.place").alias("low"), at("p.place").alias("at"), high("p.place").alias("high"))
