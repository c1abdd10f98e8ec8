"""The corpus pipeline: documents without toxic ones, near duplicates, repeated passages and benchmark items, packed.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; all but
the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm.common import as_rows, removed, scratch_dir, table, unkeyed
from maskline.llm.decontaminate import without_leaks
from maskline.llm.packing import pack_documents
from maskline.llm.phrase_dedup import dedup_phrases
from maskline.llm.similar import one_of_each_similar
from maskline.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go.

    A null text is scored as an empty one, rows that repeat are scored alike; without labels of both kinds none goes, as from an empty table.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return unkeyed(score(as_rows(docs, F.col("text")).withColumn("given", F.col("text")), model, "row", "given").where("score < 0.5").withColumnRenamed("given", "text"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word similarity of 0.8 or more stays: the one with the smallest doc_id.

    Null and empty texts, and those of white space, are one group; of rows that share the smallest id, and of rows without one, the first by their
    contents stays; equal rows are one. A text of under five words is one shingle; an empty table stays empty.
    """
    return one_of_each_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur elsewhere too go; texts without any stay as they are.

    A null text has no words and becomes an empty one; rows that repeat are places of their own; an empty table stays empty.
    """
    done = dedup_phrases(docs, tidy=False)
    return unkeyed(done, docs, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Texts without words contain none and items without words are in none; all rows that repeat go alike; an empty table of either kind removes nothing.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as packed pieces. A null or empty text is the end token alone; rows that share a doc_id are packed each for itself."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Scores, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:  # what the stage has read is needed no more
            removed(spark, done)
        done = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
