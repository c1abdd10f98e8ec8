"""Roll-ups of per-note scores into the long result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import COHORTS, METRICS
from ..functions.text import f1, rate
from .quantiles import quantiles

GROUP = ("model_id", "pass", "cohort")
OPERATIONS = ("segments", "stop", "usable", "valid", "val_requests", "prompt_tokens", "completion_tokens")


def with_operations(scores: DataFrame, operations: DataFrame) -> DataFrame:
    """Scores with each note's reliability counts; zeros and incomplete where there are none."""
    joined = scores.join(operations, ["model_id", "pass", "doc_id"], "left")
    return joined.na.fill(0, list(OPERATIONS)).na.fill(False, ["have_validation", "complete"])


def cohorts(rows: DataFrame) -> DataFrame:
    """Every note in all_expected, complete ones in operational_complete too."""
    names = F.when(F.col("complete"), F.array(*map(F.lit, COHORTS))).otherwise(F.array(F.lit(COHORTS[0])))
    return rows.withColumn("cohort", F.explode(names))


def micro(rows: DataFrame) -> DataFrame:
    """Sums, residual statistics and macro means for each model, pass and cohort; rows as from cohorts()."""
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("gt"))
    middle = quantiles(rows, GROUP, "residual", (0.5,), ("median_residual_per_note",))
    of_validated = lambda c: F.sum(F.when(F.col("have_validation"), F.col(c)).otherwise(0))
    sums = rows.groupBy(*GROUP).agg(
        F.count("*").alias("n_notes"),
        *[F.sum(c).alias(c) for c in ("doc_chars", "gt", "pred_chars", "tp", "fp", "fn", "tn", "spans", "any", "full", "strict", "relaxed", "pred_span_count", "relaxed_pred", "segments", "stop", "prompt_tokens", "completion_tokens")],
        of_validated("segments").alias("val_requests"),
        of_validated("usable").alias("usable"),
        of_validated("valid").alias("valid"),
        F.count_if(F.col("residual") == 0).alias("zero_residual_notes"),
        F.count_if(F.col("residual") > 0).alias("notes_with_leak"),
        F.avg("residual").alias("mean_residual_per_note"),
        F.max("residual").alias("max_residual_per_note"),
        F.avg(r).alias("char_recall_macro"),
        F.avg(p).alias("char_precision_macro"),
        F.avg(rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("char_f1_macro"),
        F.avg(rate(F.col("strict"), F.col("spans"))).alias("strict_span_recall_macro"),
        F.avg(rate(F.col("relaxed"), F.col("spans"))).alias("relaxed_span_recall_macro"),
    )
    return sums.join(middle, list(GROUP), "left")


def all_rows(sums: DataFrame) -> DataFrame:
    """Rows over all categories."""
    c = F.col
    recall, precision = rate(c("tp"), c("gt")), rate(c("tp"), c("tp") + c("fp"))
    out = sums.select(
        *GROUP, F.lit("ALL").alias("phi_type"), "n_notes", c("doc_chars").alias("doc_chars_total"), c("gt").alias("gt_phi_chars"), c("pred_chars").alias("pred_phi_chars"), c("spans").alias("gt_span_count"), "pred_span_count",
        c("tp").alias("char_tp"), c("fp").alias("char_fp"), c("fn").alias("char_fn"), c("tn").alias("char_tn"),
        recall.alias("char_recall"), precision.alias("char_precision"), f1(precision, recall).alias("char_f1"), rate(c("tn"), c("tn") + c("fp")).alias("char_specificity"),
        rate(c("fp"), c("tp") + c("fp")).alias("over_redaction_rate"), c("fn").alias("residual_phi_chars"), rate(c("fn"), c("gt")).alias("residual_phi_char_rate"),
        recall.alias("char_recall_typematched"), precision.alias("char_precision_typematched"), f1(precision, recall).alias("char_f1_typematched"),
        *[x for k in ("any", "full") for x in (c(k).alias(f"{k}_span_tp"), rate(c(k), c("spans")).alias(f"{k}_span_recall"))],
        *[x for k, n in (("strict", "strict"), ("relaxed", "relaxed_pred")) for x in (
            c(k).alias(f"{k}_span_tp"), rate(c(k), c("spans")).alias(f"{k}_span_recall"), rate(c(n), c("pred_span_count")).alias(f"{k}_span_precision"), f1(rate(c(n), c("pred_span_count")), rate(c(k), c("spans"))).alias(f"{k}_span_f1"))],
        "zero_residual_notes", rate(c("zero_residual_notes"), c("n_notes")).alias("zero_residual_note_rate"), "notes_with_leak", rate(c("notes_with_leak"), c("n_notes")).alias("notes_with_leak_rate"),
        "mean_residual_per_note", "median_residual_per_note", "max_residual_per_note",
        c("segments").alias("expected_requests"), c("usable").alias("usable_requests"), rate(c("usable"), c("val_requests")).alias("usable_rate"), c("valid").alias("json_valid_requests"), rate(c("valid"), c("val_requests")).alias("json_valid_rate"), rate(c("stop"), c("segments")).alias("finish_stop_rate"),
        "prompt_tokens", "completion_tokens", "char_recall_macro", "char_precision_macro", "char_f1_macro", "strict_span_recall_macro", "relaxed_span_recall_macro",
    )
    return out


def type_rows(by_type: DataFrame, rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Rows for each gold category with characters; rows as from cohorts()."""
    c = F.col
    member = rows.select("model_id", "pass", "doc_id", "cohort")
    total = by_type.join(member, ["model_id", "pass", "doc_id"]).groupBy(*GROUP, "code").agg(*[F.sum(k).alias(k) for k in ("gt", "tp", "tp_matched", "pred_matched", "fn", "spans", "any", "full", "strict", "relaxed")])
    total = total.where("gt > 0").join(sums.select(*GROUP, "n_notes"), list(GROUP))
    recall, precision = rate(c("tp_matched"), c("gt")), rate(c("tp_matched"), c("pred_matched"))
    return total.select(
        *GROUP, c("code").alias("phi_type"), "n_notes", c("gt").alias("gt_phi_chars"), c("spans").alias("gt_span_count"), c("tp").alias("char_tp"), c("fn").alias("char_fn"), rate(c("tp"), c("gt")).alias("char_recall"),
        c("fn").alias("residual_phi_chars"), rate(c("fn"), c("gt")).alias("residual_phi_char_rate"), recall.alias("char_recall_typematched"), precision.alias("char_precision_typematched"), f1(precision, recall).alias("char_f1_typematched"),
        *[x for k in ("any", "full", "strict", "relaxed") for x in (c(k).alias(f"{k}_span_tp"), rate(c(k), c("spans")).alias(f"{k}_span_recall"))],
    )


def metrics_long(scores: DataFrame, by_type: DataFrame, operations: DataFrame, configs: DataFrame | None = None, store=None) -> DataFrame:
    """The long table: model x pass x cohort x (ALL and each category), in its fixed column order.

    store(df, name) keeps the notes' rows, which are read several times.
    """
    rows = cohorts(with_operations(scores, operations))
    if store is not None:
        rows = store(rows, "rows")
    sums = micro(rows)
    out = all_rows(sums).unionByName(type_rows(by_type, rows, sums), allowMissingColumns=True)
    n_docs = rows.where(F.col("cohort") == COHORTS[0]).groupBy("model_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    out = out.join(n_docs, "model_id").withColumn("surface", F.lit("final")).withColumn("doc_provenance", F.lit(""))
    if configs is not None:
        out = out.join(configs, "model_id", "left")
    text = ("hf_link", "hf_gguf_repo", "developer", "family", "quant")
    kinds = {"params_total_B": "double", "params_active_B": "double", "moe": "boolean", "is_medical": "boolean", "is_reasoning": "boolean"}
    for name in METRICS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kinds.get(name, "string")))
    return out.select(*[F.coalesce(x, F.lit("")).alias(x) if x in text else F.col(x) for x in METRICS])


def gold_types(universe: DataFrame, gold: DataFrame) -> DataFrame:
    """Per model: sorted gold categories in its notes, joined by semicolons."""
    return universe.select("model_id", "doc_id").distinct().join(gold, "doc_id").groupBy("model_id").agg(F.array_join(F.sort_array(F.collect_set("code")), ";").alias("gold_types_present"))


def per_document(scores: DataFrame, operations: DataFrame) -> DataFrame:
    """The per-note table."""
    rows = with_operations(scores, operations)
    n = rows.groupBy("model_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    c = F.col
    return rows.join(n, "model_id").select(
        "model_id", "n_docs", c("doc_id").alias("doc"), c("pass").alias("pass_"), "doc_chars", c("gt").alias("gt_phi_chars"), c("pred_chars").alias("pred_phi_chars"), c("tp").alias("char_tp"), c("fp").alias("char_fp"), c("fn").alias("char_fn"), c("residual").alias("residual_phi_chars"), (c("residual") == 0).alias("zero_residual"),
        c("spans").alias("gt_spans"), c("any").alias("any_span_hits"), c("segments").alias("n_segments"), c("usable").alias("usable_segments"), c("stop").alias("finish_stop"), c("complete").alias("operational_complete"),
    )
