"""De-identification of notes as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import OVERLAP, WINDOW
from ..plans.deidentify import deidentify
from ..sources import tree


def note_stream(spark: SparkSession, folder: str) -> DataFrame:
    """<doc_id>.txt files of a folder, empty ones too, as a stream of (doc_id, text)."""
    return tree.note_stream(spark, folder)


def stream_spans(notes: DataFrame, extractor, model_id: str, out: str, checkpoint: str, size: int = WINDOW, overlap: int = OVERLAP):
    """Run both passes over every micro-batch and write its spans to out/batch=<id>; a repeated batch overwrites its own."""

    def run(batch: DataFrame, number: int) -> None:
        done = deidentify(batch.withColumn("model_id", F.lit(model_id)), extractor, size, overlap)
        done.spans.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return notes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
