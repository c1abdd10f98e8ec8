"""Spans: grounding, union, redaction, and the way back from redacted text.

Spans are half-open [start, end) in codepoints. `keys` name the columns that tell notes apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import MARKERS, NEUTRAL
from .locate import occurrences
from .narrow import narrowed, parted


def ground(pairs: DataFrame, notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pairs(keys, exact_text, identifier_type) at every occurrence in notes(keys, text), which keys tell apart: typed spans, each once.

    A note's literals come together, and its text moves once to meet them, if it has any; one automaton finds them all. What a note's
    windows have answered is no longer than the note with its windows' overlaps, so it is a row's worth.
    """
    given = pairs.where(F.length("exact_text") > 0).groupBy(*keys, F.col("exact_text").alias("literal")).agg(F.sort_array(F.collect_set("identifier_type")).alias("labels"))
    own = given.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("literal", "labels"))).alias("literals")).persist(StorageLevel.DISK_ONLY)
    found = occurrences(own.join(narrowed(notes.select(*keys, "text"), own, keys), list(keys)), keys)
    return found.withColumnRenamed("label", "identifier_type")


def merge(*spans: DataFrame) -> DataFrame:
    """Set union of typed spans."""
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out.distinct()


def _islands(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans with the number of the region they are in; spans that only touch are apart."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    return flagged.withColumn("region_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def regions(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint regions that cover the spans: (keys, region_no, start, end)."""
    distinct = spans.select(*keys, "start", "end").distinct()
    return _islands(distinct, keys).groupBy(*keys, "region_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def components(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Regions with the sorted set of their types."""
    distinct = spans.select(*keys, "start", "end", "identifier_type").distinct()
    return _islands(distinct, keys).groupBy(*keys, "region_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("identifier_type")).alias("types"))


def typed_marker(types: Column) -> Column:
    """Marker of a region: its type's, or all its codes."""
    known = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    return F.when(F.size(types) == 1, known[types[0]]).otherwise(F.concat(F.lit("[MULTIPLE_PHI:"), F.array_join(types, "|"), F.lit("]")))


def render(notes: DataFrame, marked: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """notes(keys, text) with marked(keys, start, end, marker) put in their place, as column `name`.

    Empty, overlapping or overrunning regions are an error. Notes without regions stay where they are.
    """
    ordered = marked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "marker"))).alias("_r"))
    r, text = F.col("_r"), F.col("text")
    end_before = lambda i: F.when(i > 0, F.element_at(r, F.greatest(i, F.lit(1)))["end"]).otherwise(0)
    bad = F.exists(F.transform(r, lambda x, i: (x["start"] < end_before(i)) | (x["end"] <= x["start"]) | (x["end"] > F.length(text))), lambda b: b)
    pieces = F.transform(r, lambda x, i: F.concat(F.substring(text, end_before(i) + 1, x["start"] - end_before(i)), x["marker"]))
    done = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(r, -1)["end"] + 1, F.length(text)))
    out = F.when(F.coalesce(F.size(r), F.lit(0)) <= 0, text).when(bad, F.raise_error("render_region_invalid").cast("string")).otherwise(done)
    some, others = parted(notes, marked, keys)
    done = some.join(ordered, list(keys), "left").withColumn(name, out).drop("_r")
    return done.unionByName(others.withColumn(name, text))


def neutral(notes: DataFrame, found: DataFrame, keys: Sequence[str], name: str = "neutral_text") -> DataFrame:
    return render(notes, found.withColumn("marker", F.lit(NEUTRAL)), keys, name)


def typed(notes: DataFrame, spans: DataFrame, keys: Sequence[str], name: str = "typed_text") -> DataFrame:
    return render(notes, components(spans, keys).withColumn("marker", typed_marker(F.col("types"))), keys, name)


def pieces(notes: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What redaction keeps: (keys, piece_no, rep_start, rep_end, src_start), in redacted and source places."""
    order = Window.partitionBy(*keys).orderBy("start")
    shift = F.sum(len(NEUTRAL) - (F.col("end") - F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = found.select(*keys, F.col("region_no").cast("int").alias("piece_no"), F.col("end").alias("src_start"), F.lead("start").over(order).alias("src_end"), shift.alias("shift"))
    head = found.where("region_no = 1").select(*keys, F.col("start").alias("_first"))
    whole = notes.select(*keys, F.length("text").alias("n"))
    first = whole.join(head, list(keys), "left").select(*keys, F.lit(0).alias("piece_no"), F.lit(0).alias("src_start"), F.coalesce("_first", "n").alias("src_end"), F.lit(0).cast("long").alias("shift"))
    rest = after.join(whole, list(keys)).select(*keys, "piece_no", "src_start", F.coalesce("src_end", "n").alias("src_end"), "shift")
    both = first.unionByName(rest)
    place = lambda c: (F.col(c) + F.col("shift")).cast("int")
    return both.select(*keys, "piece_no", place("src_start").alias("rep_start"), place("src_end").alias("rep_end"), "src_start")


def map_back(spans: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans of redacted text in source places; those that touch a marker vanish."""
    s = spans.withColumnsRenamed({"start": "_a", "end": "_b"})
    inside = s.join(kept, list(keys)).where("rep_start <= _a and _b <= rep_end and _a < _b")
    at = F.col("src_start") + F.col("_a") - F.col("rep_start")
    return inside.select(*keys, at.cast("int").alias("start"), (at + F.col("_b") - F.col("_a")).cast("int").alias("end"), "identifier_type").distinct()


def resolved_documents(notes: DataFrame, spans: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The stored form of a note's spans: source digest, sorted predictions, no literal text."""
    listed = spans.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("start", "end", "identifier_type"))).alias("predictions"))
    return notes.join(listed, list(keys), "left").select(
        *keys, F.lit(version).alias("schema_version"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"), F.lit("Unicode codepoint; half-open [start,end)").alias("offset_unit"), F.lit(False).alias("contains_literal_text"),
        F.coalesce("predictions", F.array().cast("array<struct<start:int,end:int,identifier_type:string>>")).alias("predictions"),
    )
