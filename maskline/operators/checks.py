"""Errors as rows: what breaks an invariant gets a code and goes to a table of its own, and counts are taken in the running job.

`raise_error` stops a job at the first bad row. Over many notes it is often better that the good ones go on: here a row
has `error_code`, null where it is good; `parted` splits such rows, and `observed` counts them, by code, as an observation of
whatever job reads them, without a pass of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.constants import OVERLAP, WINDOW

# Codes of segments, regions, notes and gold that are not as they must be.
SEGMENT_CODES = ("segmentation_coverage_invalid", "segmentation_stride_invalid", "segmentation_slice_invalid")
REGION_CODES = ("render_region_invalid",)
NOTE_CODES = ("document_id_invalid", "document_id_repeated", "text_missing")
GOLD_CODES = ("gold_missing", "literal_not_found")


def first_code(**bad: Column) -> Column:
    """The first code whose condition holds; null where none does."""
    return F.coalesce(*[F.when(condition, F.lit(code)) for code, condition in bad.items()])


def observed(rows: DataFrame, codes: Sequence[str], **counts: Column) -> tuple[DataFrame, Observation]:
    """rows(error_code, ...) whose next job tells how many rows there are of each code, and these counts."""
    seen = Observation()
    of = [F.count_if(F.col("error_code") == c).alias(c) for c in codes]
    return rows.observe(seen, F.count("*").alias("rows"), *of, *[c.alias(n) for n, c in counts.items()]), seen


def parted(rows: DataFrame, store: Callable[[DataFrame, str], DataFrame], *keys: str) -> tuple[DataFrame, DataFrame]:
    """rows(error_code, ...) -> good rows, without the code, and bad ones as (error_code, keys). store keeps rows between the two."""
    kept = store(rows, "checked")
    return kept.where("error_code is null").drop("error_code"), kept.where("error_code is not null").select("error_code", *keys)


def segment_codes(cut: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """cut(segment_id, start, end, text, n_chars of the whole note) with each window's error_code, told from the window alone."""
    i = F.substring("segment_id", 2, 20).cast("long") - 1
    start, end, n = F.col("start"), F.col("end"), F.col("n_chars")
    last = end == n
    return cut.withColumn(
        "error_code",
        first_code(
            segmentation_coverage_invalid=((i == 0) & (start != 0)) | (end > n) | (~last & (start + size >= n)),
            segmentation_stride_invalid=(start != i * (size - overlap)) | (~last & (end - start != size)),
            segmentation_slice_invalid=F.length("text") != end - start,
        ),
    )


def observed_segments(cut: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> tuple[DataFrame, Observation]:
    """Windows with codes, and an observation: also of notes, of their codepoints, and of how many windows these must have.

    Fewer `rows` than `expected`: windows are missing, which no single one can tell.
    """
    first, n = F.col("start") == 0, F.col("n_chars")
    must = F.ceil(F.greatest(n - size, F.lit(0)) / (size - overlap)).cast("long") + 1
    zero = lambda c: F.coalesce(F.sum(F.when(first, c)), F.lit(0))
    return observed(segment_codes(cut, size, overlap), SEGMENT_CODES, notes=F.count_if(first), chars=zero(n.cast("long")), expected=zero(must))


def region_codes(notes: DataFrame, marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """notes(keys, text) with the code of notes whose regions marked(keys, start, end) are empty, overlap or run over the text."""
    ordered = marked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_r"))
    r = F.col("_r")
    before = lambda i: F.when(i > 0, F.element_at(r, F.greatest(i, F.lit(1)))["end"]).otherwise(0)
    bad = F.exists(F.transform(r, lambda x, i: (x["start"] < before(i)) | (x["end"] <= x["start"]) | (x["end"] > F.length("text"))), lambda b: b)
    return notes.join(ordered, list(keys), "left").withColumn("error_code", first_code(render_region_invalid=F.coalesce(bad, F.lit(False)))).drop("_r")


def note_codes(notes: DataFrame) -> DataFrame:
    """notes(doc_id, text) with codes: ids of other characters than are allowed, ids of several rows, and no text at all."""
    doc = F.col("doc_id").cast("string")
    # how many rows an id has is summed before it moves
    repeated = notes.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id", F.lit(True).alias("_again"))
    bad_id = ~F.coalesce(doc.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))
    return notes.join(repeated, "doc_id", "left").withColumn("error_code", first_code(document_id_invalid=bad_id, document_id_repeated=F.coalesce("_again", F.lit(False)), text_missing=F.col("text").isNull())).drop("_again")


def gold_codes(universe: DataFrame, gold_docs: DataFrame) -> DataFrame:
    """universe(..., doc_id) with the code of notes that have to be scored and have no gold."""
    has = gold_docs.select("doc_id", F.lit(True).alias("_has")).distinct()
    return universe.join(has, "doc_id", "left").withColumn("error_code", first_code(gold_missing=F.col("_has").isNull())).drop("_has")


def literal_codes(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """annotations(doc_id, exact_text, ...) with the code of literals that are empty or not in their note."""
    there = F.coalesce(F.contains("text", F.col("exact_text")) & (F.col("exact_text") != ""), F.lit(False))
    return annotations.join(notes.select("doc_id", "text"), "doc_id", "left").withColumn("error_code", first_code(literal_not_found=~there)).drop("text")
