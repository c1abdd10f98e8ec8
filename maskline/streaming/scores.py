"""Sums of scores over a stream of notes in which a note may come again, changed or late.

A stream has a row for each scored note: (model_id, pass, doc_id, version, complete, SUMMED). Each note's state is its share as
it counts now; a row with a higher version replaces it, one with the same or a lower version changes nothing. What leaves the
state is the difference, so a batch only adds up differences, and the sums over all batches are those of every note's last
version, in whatever order and however often rows come. State is keyed by note, so no model's notes meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import COHORTS
from ..plans.changes import GROUP, SUMMED

NOTE = ("model_id", "pass", "doc_id")
ROW = "model_id string, pass string, doc_id string, version long, complete boolean, " + ", ".join(f"`{c}` long" for c in SUMMED)
_STATE = "version long, complete boolean, " + ", ".join(f"`{c}` long" for c in SUMMED)
CHANGE = "model_id string, pass string, cohort string, n_notes long, " + ", ".join(f"`{c}` long" for c in SUMMED)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Shares(StatefulProcessor):
    """The share of a note, and how it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.share = handle.getValueState("share", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for pdf in rows:
            row = pdf.loc[pdf["version"].idxmax()]
            if newest is None or row["version"] > newest["version"]:
                newest = row
        old = self.share.get() if self.share.exists() else None
        if newest is None or (old is not None and newest["version"] <= old[0]):
            return
        new = [int(newest["version"]), bool(newest["complete"]), *(int(newest[c]) for c in SUMMED)]
        self.share.update(tuple(new))
        zero = [0] * (1 + len(SUMMED))
        out = []
        for cohort in COHORTS:
            now, was = ([1, *x[2:]] if x is not None and (cohort == COHORTS[0] or x[1]) else zero for x in (new, old))
            if now is not zero or was is not zero:
                out.append([key[0], key[1], cohort, *(np.array(now, np.int64) - np.array(was, np.int64)).tolist()])
        yield pd.DataFrame(out, columns=["model_id", "pass", "cohort", "n_notes", *SUMMED])

    def close(self) -> None:
        pass


def rows_of(documents: DataFrame, operations: DataFrame, version: int) -> DataFrame:
    """Scored notes as rows of the stream."""
    joined = documents.join(operations, list(NOTE), "left")
    return joined.select("model_id", "pass", F.col("doc_id").cast("string").alias("doc_id"), F.lit(version).cast("long").alias("version"), F.coalesce("complete", F.lit(False)).alias("complete"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in SUMMED])


def stream_sums(rows: DataFrame, out: str, checkpoint: str):
    """Start a query over a stream of such rows; each batch writes its differences to out/batch=<number>, over what it may have written before."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    changed = rows.groupBy(*NOTE).transformWithStateInPandas(Shares(), CHANGE, "append", "none")

    def run(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("n_notes", *SUMMED)])
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """(model_id, pass, cohort, n_notes, SUMMED) over all batches so far, as a batch job over every note's last version has it."""
    found = spark.read.schema(f"{CHANGE}, batch long").parquet(out)
    return found.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("n_notes", *SUMMED)]).where("n_notes > 0")
