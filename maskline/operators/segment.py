"""Fixed overlapping windows over notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import OVERLAP, WINDOW
from .checks import segment_codes


def segments(notes: DataFrame, size: int = WINDOW, overlap: int = OVERLAP, text: str = "text", measured: bool = False) -> DataFrame:
    """notes(..., text) -> a row for each window: segment_id, start, end and the window's text; where measured, n_chars of the whole note too.

    Windows start every size - overlap codepoints until one reaches the end; an empty text has one.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("segmentation_parameters_invalid")
    step = size - overlap
    n = F.length(text)
    count = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int") + 1
    at = F.col("i") * step
    rows = notes.withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    end = F.least(at + size, n).cast("int")
    others = [F.col(c) for c in notes.columns if c != text] + ([n.alias("n_chars")] if measured else [])
    return rows.select(*others, F.format_string("S%04d", F.col("i") + 1).alias("segment_id"), at.cast("int").alias("start"), end.alias("end"), F.substring(F.col(text), at + 1, end - at).alias("text"))


def check_segments(notes: DataFrame, cut: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Notes whose stored windows break an invariant: (doc_id, error_code). A running job observes its windows instead (`checks.py`)."""
    step = size - overlap
    whole = notes.select("doc_id", F.col("text").alias("whole"), F.length("text").alias("n_chars"))
    w = whole.join(cut.select("doc_id", "segment_id", "start", "end", "text"), "doc_id", "left")
    coded = segment_codes(w.withColumn("text", F.when(F.col("text") == F.expr("substring(whole, start + 1, end - start)"), F.col("text"))), size, overlap)
    code = F.when(F.col("start").isNotNull(), F.when(F.col("text").isNull(), "segmentation_slice_invalid").otherwise(F.col("error_code")))
    must = F.ceil(F.greatest(F.col("n_chars") - size, F.lit(0)) / step) + 1
    found = coded.groupBy("doc_id").agg(F.min(code).alias("error_code"), F.count("start").alias("n"), F.first(must).alias("must"))
    missing = F.when(F.col("n") != F.col("must"), "segmentation_coverage_invalid")
    return found.select("doc_id", F.coalesce("error_code", missing).alias("error_code")).where("error_code is not null")
