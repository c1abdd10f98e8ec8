"""The two-pass job: notes to spans, and spans to scores."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import OVERLAP, PASSES, WINDOW
from ..operators import aggregate, score, spans, validate
from ..operators.segment import segments
from ..sources.sinks import shared_folder

KEYS = ("model_id", "doc_id")


@dataclass
class Run:
    """Everything that a run makes; each table has model_id and doc_id, and pass where it says so."""

    notes: DataFrame
    responses: DataFrame  # with pass
    validations: DataFrame  # with pass
    spans: DataFrame  # with pass
    redacted: DataFrame  # Pass-1 redacted text
    pieces: DataFrame


def _pass(number: int, texts: DataFrame, extractor, size: int, overlap: int, store):
    cut = segments(texts, size, overlap)
    # asked and parsed once: a served model need not answer the same way twice
    responses = store(validate.parsed(extractor.respond(cut).withColumn("given_reason", F.col("finish_reason"))), f"responses_{number}")
    key = (*KEYS, "segment_id")
    found = validate.pairs(validate.verdicts(responses, *key), *KEYS)
    given = responses.drop("parsed").withColumn("finish_reason", F.col("given_reason")).drop("given_reason")
    return given, validate.validations(responses, *key), found


def kept_on_disk(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: never made twice, and what is built on it has a short plan and reads the columns that it needs only."""
    spark = df.sparkSession
    folder = f"{spark.sparkContext.getCheckpointDir() or shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def deidentify(notes: DataFrame, extractor, size: int = WINDOW, overlap: int = OVERLAP, store=kept_on_disk) -> Run:
    """notes(model_id, doc_id, text) through both passes.

    store(df, name) keeps responses between their uses; give one that writes tables for a served model.
    New spans of Pass 2 count for a note only if all its Pass-2 responses are finished and usable.
    """
    r1, v1, p1 = _pass(1, notes, extractor, size, overlap, store)
    first = store(spans.ground(p1, notes, KEYS), "spans_1")
    found = spans.regions(first, KEYS)
    redacted = spans.neutral(notes, found, KEYS).select(*KEYS, F.col("neutral_text").alias("text"))
    kept = spans.pieces(notes, found, KEYS)
    r2, v2, p2 = _pass(2, redacted, extractor, size, overlap, store)
    passed = v2.groupBy(*KEYS).agg(F.bool_and((F.col("finish_reason") == "stop") & F.col("envelope_usable")).alias("ok")).where("ok")
    second = spans.map_back(spans.ground(p2, redacted, KEYS), kept, KEYS).join(passed, list(KEYS), "left_semi")
    tag = lambda df, i: df.withColumn("pass", F.lit(PASSES[i]))
    return Run(
        notes,
        tag(r1, 0).unionByName(tag(r2, 1)),
        tag(v1, 0).unionByName(tag(v2, 1)),
        tag(first, 0).unionByName(tag(spans.merge(first, second), 1)),
        redacted,
        kept,
    )


@dataclass
class Scores:
    documents: DataFrame
    types: DataFrame
    operations: DataFrame
    metrics: DataFrame
    per_document: DataFrame
    manifest: DataFrame


def score_run(universe: DataFrame, gold_docs: DataFrame, gold: DataFrame, predicted: DataFrame, responses: DataFrame, validations: DataFrame, configs: DataFrame | None = None, store=kept_on_disk) -> Scores:
    """All tables of the scorer; a scored note without gold is an error."""
    checked = universe.join(gold_docs.select("doc_id", F.lit(True).alias("_has")), "doc_id", "left")
    universe = checked.where(F.when(F.col("_has").isNull(), F.raise_error(F.concat(F.lit("no gold for note "), F.col("doc_id").cast("string"))).cast("boolean")).otherwise(True)).drop("_has")
    universe, predicted, gold = store(universe, "universe"), store(predicted, "predicted"), store(gold, "gold")
    documents, types = (store(x, n) for x, n in zip(both_scores(universe, gold_docs, gold, predicted, store), ("documents", "types")))
    operations = store(score.document_operations(responses, validations), "operations")
    metrics = store(aggregate.metrics_long(documents, types, operations, configs, store), "metrics")
    dims = metrics.select("model_id", "n_docs", "doc_provenance", "hf_link", "hf_gguf_repo", "developer", "family", "params_total_B", "params_active_B", "moe", "is_medical", "is_reasoning", "quant").distinct()
    manifest = dims.join(aggregate.gold_types(universe, gold), "model_id", "left").withColumn("gold_types_present", F.coalesce("gold_types_present", F.lit(""))).withColumn("model_dir", F.col("model_id"))
    return Scores(documents, types, operations, metrics, aggregate.per_document(documents, operations), manifest)


def both_scores(universe: DataFrame, gold_docs: DataFrame, gold: DataFrame, predicted: DataFrame, store=kept_on_disk) -> tuple[DataFrame, DataFrame]:
    """Scores by note and by note and category, which share the spans' hits."""
    hits = store(score.span_hits(universe, gold_docs, gold, predicted), "hits")
    return score.document_scores(universe, gold_docs, gold, predicted, hits), score.type_scores(universe, gold_docs, gold, predicted, hits)


def both_passes(first_pass: DataFrame) -> DataFrame:
    """The universe: each note with Pass-1 output (model_id, doc_id), under both passes."""
    return first_pass.select("model_id", "doc_id").distinct().withColumn("pass", F.explode(F.array(*map(F.lit, PASSES))))
