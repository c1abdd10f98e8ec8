"""Gold records: annotated literals at all their places, in the shape of annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import ground

_RECORD = "denotations array<struct<id:string,obj:string,span:struct<begin:int,end:int>>>, attributes array<struct<id:string,subj:string,obj:string,pred:string>>"


def gold_records(notes: DataFrame, annotations: DataFrame, source: str) -> DataFrame:
    """notes(doc_id, text), annotations(doc_id, exact_text, identifier_type) -> a record for each note.

    Spans are sorted by place, then category, and numbered from 1. A literal that is not in its note is an error.
    """
    checked = annotations.distinct().join(notes, "doc_id", "left")
    absent = F.raise_error(F.concat(F.lit("literal not found in note "), F.col("doc_id").cast("string"), F.lit(": "), F.col("exact_text")))
    there = checked.where(F.when(F.coalesce(F.contains("text", F.col("exact_text")) & (F.col("exact_text") != ""), F.lit(False)), True).otherwise(absent.cast("boolean")))
    found = ground(there.select("doc_id", "exact_text", "identifier_type"), notes, ["doc_id"])
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "identifier_type"))
    each = found.withColumn("n", n).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "start", "end", "identifier_type"))).alias("s"))
    term = lambda x: F.concat(F.lit("T"), x["n"].cast("string"))
    span = lambda x: F.struct(x["start"].alias("begin"), x["end"].alias("end"))
    # Names in the record.
    denotations = F.transform("s", lambda x: F.struct(term(x).alias("id"), F.lit("PHI_IDENTIFIER").alias("obj"), span(x).alias("span")))
    attributes = F.transform("s", lambda x: F.struct(F.concat(F.lit("A"), x["n"].cast("string")).alias("id"), term(x).alias("subj"), x["identifier_type"].alias("obj"), F.lit("identifier_type").alias("pred")))
    none = lambda i: F.array().cast(_RECORD.split(", ")[i].split(" ", 1)[1])
    joined = notes.join(each, "doc_id", "left")
    return joined.select("doc_id", F.lit(source).alias("sourcedb"), F.col("doc_id").cast("string").alias("sourceid"), "text", F.coalesce(denotations, none(0)).alias("denotations"), F.coalesce(attributes, none(1)).alias("attributes"))
