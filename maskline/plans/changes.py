"""Runs by change: notes whose source is the stored one keep what was made of them.

A stored run is a folder of tables, one folder for each version. A note's digest says whether it has changed; only notes that
are new or changed are run and scored again. Everything that a note has is its own, so the next version is the
stored rows of the other notes with the new rows of these, and sums are the stored sums corrected by differences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import OVERLAP, WINDOW
from ..operators import score
from ..operators.aggregate import cohorts, with_operations
from .deidentify import KEYS, Run, both_passes, both_scores, deidentify, kept_on_disk

#: Tables of a stored run, each with model_id and doc_id.
TABLES = ("digests", "responses", "validations", "spans", "documents", "types", "operations")
#: What is summed over notes: (model_id, pass, cohort) has their sums and how many there are.
SUMMED = ("doc_chars", "gt", "pred_chars", "tp", "fp", "fn", "tn", "spans", "any", "full", "strict", "relaxed", "pred_span_count", "relaxed_pred", "segments", "stop", "usable", "valid", "prompt_tokens", "completion_tokens")
GROUP = ("model_id", "pass", "cohort")


def digests(notes: DataFrame) -> DataFrame:
    """(model_id, doc_id, source_sha256), as resolved documents have it."""
    return notes.select(*KEYS, F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"))


@dataclass
class Changes:
    """Which notes (model_id, doc_id) are new or have another text, and which are gone."""

    fresh: DataFrame
    gone: DataFrame

    @property
    def stale(self) -> DataFrame:
        """Notes of which nothing stored counts any more."""
        return self.fresh.unionByName(self.gone)


def changes(notes: DataFrame, stored: DataFrame | None) -> Changes:
    """notes(model_id, doc_id, text) against stored digests. Texts stay where they are: only digests are compared."""
    now = digests(notes)
    if stored is None:
        return Changes(now.select(*KEYS), now.select(*KEYS).limit(0))
    return Changes(now.join(stored, [*KEYS, "source_sha256"], "left_anti").select(*KEYS), stored.join(now.select(*KEYS), list(KEYS), "left_anti").select(*KEYS))


def sums(documents: DataFrame, operations: DataFrame) -> DataFrame:
    """(model_id, pass, cohort, n_notes, SUMMED): what notes add up to."""
    rows = cohorts(with_operations(documents, operations))
    return rows.groupBy(*GROUP).agg(F.count("*").alias("n_notes"), *[F.sum(c).alias(c) for c in SUMMED])


def corrected(before: DataFrame, taken: DataFrame, added: DataFrame) -> DataFrame:
    """Sums less those of the notes that count no more, with those of the notes that count now; what has no note left has no row."""
    names = ("n_notes", *SUMMED)
    minus = taken.select(*GROUP, *[(-F.col(c)).alias(c) for c in names])
    return before.unionByName(minus).unionByName(added).groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in names]).where("n_notes > 0")


class Store:
    """Versions of a run in a folder; a version that was not finished is none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def latest(self) -> int | None:
        """The last finished version, which its `sums` table, written last, tells."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = files.Path(self.folder)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = system.globStatus(files.Path(f"{self.folder}/version=*/sums/_SUCCESS")) or []
        return max((int(x.getPath().getParent().getParent().getName().removeprefix("version=")) for x in found), default=None)

    def read(self, version: int, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/version={version}/{table}")

    def write(self, version: int, table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/version={version}/{table}")
        return self.read(version, table)


def _tables(run: Run, gold_docs: DataFrame, gold: DataFrame, store) -> dict[str, DataFrame]:
    """What the notes of a run have."""
    universe = both_passes(run.notes)
    spans = store(run.spans, "spans")
    own = run.notes.select("doc_id").distinct()
    documents, types = both_scores(universe, gold_docs.join(own, "doc_id", "left_semi"), gold.join(own, "doc_id", "left_semi"), spans, store)
    return {
        "digests": digests(run.notes),
        "responses": run.responses.drop("text"),
        "validations": run.validations,
        "spans": spans,
        "documents": documents,
        "types": types,
        "operations": score.document_operations(run.responses, run.validations),
    }


def update(notes: DataFrame, gold_docs: DataFrame, gold: DataFrame, extractor, folder: str, size: int = WINDOW, overlap: int = OVERLAP) -> int:
    """Bring a stored run up to date with notes(model_id, doc_id, text) and write its next version; returns the number of notes that were run.

    Gold is taken as unchanged for notes whose text is. A job that fails leaves the last version as it was.
    """
    stored = Store(notes.sparkSession, folder)
    last = stored.latest()
    version = 0 if last is None else last + 1
    found = changes(notes, None if last is None else stored.read(last, "digests"))
    fresh, stale = kept_on_disk(found.fresh, "fresh"), kept_on_disk(found.stale, "stale")
    run = deidentify(notes.join(fresh, list(KEYS), "left_semi"), extractor, size, overlap)
    new = _tables(run, gold_docs, gold, kept_on_disk)
    written = {}
    for name in TABLES:
        # the rows of the other notes stay as they are
        rows = new[name] if last is None else stored.read(last, name).join(stale, list(KEYS), "left_anti").unionByName(new[name])
        written[name] = stored.write(version, name, rows)
    mine = lambda name, of, keys: written[name].join(of, list(keys), "left_semi")
    added = sums(mine("documents", fresh, KEYS), mine("operations", fresh, KEYS))
    if last is None:
        stored.write(version, "sums", added)
    else:
        old = lambda name: stored.read(last, name).join(stale, list(KEYS), "left_semi")
        stored.write(version, "sums", corrected(stored.read(last, "sums"), sums(old("documents"), old("operations")), added))
    return fresh.count()
