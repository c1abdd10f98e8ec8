"""Report tables over the result tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import ALPHA, BOOTSTRAP_SEED, CHECKPOINTS, COHORTS, PASSES, RESAMPLES
from ..operators.quantiles import quantiles
from ..operators.spans import regions

# Columns of the results table, and categories of the last figure with their labels.
DISPLAY = ("params_total_B", "is_medical", "char_recall", "char_precision", "char_f1", "strict_span_recall", "relaxed_span_recall", "zero_residual_note_rate", "notes_with_leak_rate")
CATEGORIES = (("03_DATE", "date"), ("01_NAME", "name"), ("05_TELEPHONE_NUMBER", "telephone"), ("02_GEOGRAPHIC_SUBDIVISION", "geographic"), ("ALL", "overall"))


def ranked(metrics: DataFrame, pass_: str = PASSES[1], cohort: str = COHORTS[0], columns: tuple[str, ...] = DISPLAY) -> DataFrame:
    """Models by falling character recall, undefined last, ties by id; ranks are all different."""
    rows = metrics.where((F.col("phi_type") == "ALL") & (F.col("pass") == pass_) & (F.col("cohort") == cohort))
    # one row for each model
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("char_recall").desc_nulls_last(), "model_id")
    return rows.select(F.row_number().over(order).alias("rank"), "model_id", *columns)


def figure2(metrics: DataFrame) -> DataFrame:
    return ranked(metrics, columns=("char_recall", "zero_residual_note_rate")).drop("rank")


def figure3(metrics: DataFrame) -> DataFrame:
    return ranked(metrics, columns=("over_redaction_rate", "char_recall")).drop("rank")


def figure4(metrics: DataFrame) -> DataFrame:
    return ranked(metrics, columns=("any_span_recall", "full_span_recall", "relaxed_span_recall", "strict_span_recall")).drop("rank")


def figure5(metrics: DataFrame) -> DataFrame:
    """Recall of both passes and what the second adds."""
    rows = metrics.where((F.col("phi_type") == "ALL") & (F.col("cohort") == COHORTS[0]))
    of = lambda p: F.max(F.when(F.col("pass") == p, F.col("char_recall")))
    out = rows.groupBy("model_id").agg(of(PASSES[0]).alias("char_recall_pass1"), of(PASSES[1]).alias("char_recall_cumulative_pass2"))
    return out.withColumn("added_by_pass2", F.round(F.col("char_recall_cumulative_pass2") - F.col("char_recall_pass1"), 6))


def figure6(metrics: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Recall by category, a column for each."""
    rows = metrics.where((F.col("pass") == PASSES[1]) & (F.col("cohort") == COHORTS[0]))
    wide = rows.groupBy("model_id").pivot("phi_type", [c for c, _ in categories]).agg(F.first("char_recall"))
    return wide.select("model_id", *[F.col(c).alias(n) for c, n in categories])


def corpus_totals(gold_docs: DataFrame, gold: DataFrame) -> DataFrame:
    """Panel A: notes, lengths and their quartiles, spans, characters, density and categories."""
    cover = regions(gold, ["doc_id"]).agg(F.sum(F.col("end") - F.col("start")).alias("phi_chars"))
    spans_ = gold.agg(F.count("*").alias("spans"), F.count_distinct("code").alias("categories"))
    notes = gold_docs.agg(F.count("*").alias("notes"), F.sum("n_chars").cast("long").alias("chars"))
    quarters = quantiles(gold_docs, (), "n_chars", (0.5, 0.25, 0.75), ("median_chars", "q1_chars", "q3_chars"))
    # each side is one row
    one = notes.crossJoin(spans_).crossJoin(cover).crossJoin(quarters)
    return one.select("notes", "chars", "spans", "phi_chars", "categories", "median_chars", "q1_chars", "q3_chars", (100.0 * F.col("phi_chars") / F.col("chars")).alias("density_pct"))


def corpus_categories(gold: DataFrame) -> DataFrame:
    """Panel B: spans, share and union characters of each category, most spans first."""
    chars = regions(gold, ["doc_id", "code"]).groupBy("code").agg(F.sum(F.col("end") - F.col("start")).alias("chars"))
    n = gold.groupBy("code").agg(F.count("*").alias("spans"))
    share = 100.0 * F.col("spans") / F.sum("spans").over(Window.partitionBy(F.lit(0)))
    return n.join(chars, "code").select("code", "spans", share.alias("share_pct"), "chars").orderBy(F.desc("spans"), "code")


def checkpoints(spark: SparkSession) -> DataFrame:
    """The study's checkpoint table, in its order."""
    fields = "model_id model developer family total active moe medical quant size_gb repo".split()
    rows = [(i, *line.split("|")) for i, line in enumerate(CHECKPOINTS.split("\n")[1:-1], 1)]
    given = spark.createDataFrame(rows, "ord int, " + ", ".join(f"{f} string" for f in fields))
    active = F.when((F.col("moe") == "true") & (F.col("active") != ""), F.concat(F.lit(" ("), F.col("active"), F.lit(" active)"))).otherwise("")
    return given.select("ord", "model_id", "model", "developer", F.concat("total", active).alias("params"), F.when(F.col("moe") == "true", "MoE").otherwise("dense").alias("arch"), F.when(F.col("medical") == "true", "yes").otherwise("").alias("medical"), "quant", F.col("size_gb").cast("double").alias("size_gb"), "repo")


#: Notes that are drawn at once, few enough for a processor's cache; sums over them fit into half a long.
DRAWN_AT_ONCE = 1 << 16


def _percentile(values: np.ndarray, q: float) -> float:
    k = (len(values) - 1) * q
    low = int(k)
    return float(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (k - low))


def choices_recalls(gt: np.ndarray, tp: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Sorted pooled recalls of resamples as `random.choices` draws them; those without gold have none."""
    n, found = len(gt), []
    small = n and max(int(gt.max()), int(tp.max())) * min(n, DRAWN_AT_ONCE) < 1 << 31
    if small:  # one look at a note instead of two, at the number of its pair: a short table stays in the cache
        pairs, number = np.unique((gt.astype(np.int64) << 32) | tp, return_inverse=True)
        number = number.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
    _, state, _ = random.Random(seed).getstate()
    draw = np.random.RandomState()
    draw.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    for _ in range(resamples):
        whole = hit = 0
        for at in range(0, n, DRAWN_AT_ONCE):
            chosen = draw.random_sample(min(DRAWN_AT_ONCE, n - at))
            chosen *= n
            chosen = chosen.astype(np.int64)
            if small:
                total = int(pairs.take(number.take(chosen, mode="clip"), mode="clip").sum())
                whole, hit = whole + (total >> 32), hit + (total & 0xFFFFFFFF)
            else:
                whole, hit = whole + int(gt[chosen].sum()), hit + int(tp[chosen].sum())
        if whole:
            found.append(hit / whole)
    return np.sort(np.array(found))


def _choices(resamples: int, seed: int, alpha: float):
    """Rows sorted by (model_id, pass_, doc) -> a row for each group; of a note its two numbers are held only."""

    def done(key: tuple, parts: list) -> pa.RecordBatch:
        gt, tp = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        parts.clear()
        found = choices_recalls(gt, tp, resamples, seed)
        low, high = (_percentile(found, alpha / 2), _percentile(found, 1 - alpha / 2)) if len(found) else (None, None)
        row = {"model_id": key[0], "pass_": key[1], "notes": len(gt), "recall": int(tp.sum()) / int(gt.sum()) if gt.sum() else None, "low": low, "high": high}
        return pa.RecordBatch.from_pylist([row], pa.schema([("model_id", pa.string()), ("pass_", pa.string()), ("notes", pa.int64()), ("recall", pa.float64()), ("low", pa.float64()), ("high", pa.float64())]))

    def run(batches):
        key, parts = None, []
        for batch in batches:
            names = list(zip(batch.column("model_id").to_pylist(), batch.column("pass_").to_pylist()))
            counts = [batch.column(c).to_numpy().copy() for c in ("gt_phi_chars", "char_tp")]
            begins = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, b in zip(begins, [*begins[1:], len(names)]):
                if parts and names[a] != key:
                    yield done(key, parts)
                key = names[a]
                parts.append([c[a:b] for c in counts])
        if parts:
            yield done(key, parts)

    return run


def bootstrap_exact(per_document: DataFrame, resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED, alpha: float = ALPHA) -> DataFrame:
    """Percentile intervals of pooled recall with the random stream of Python's `random.choices`, notes in doc order.

    per_document(model_id, pass_, doc, gt_phi_chars, char_tp). The stream has one order, so a model's notes of one
    pass are one task's; Spark sorts them, and the task holds two numbers of each, 16 bytes. For more notes than that holds, or
    than can be drawn in time, use `bootstrap`.
    """
    group = ["model_id", "pass_"]
    each = per_document.select(*[F.col(c).cast("string").alias(c) for c in group], "doc", *[F.col(c).cast("long").alias(c) for c in ("gt_phi_chars", "char_tp")]).persist(StorageLevel.DISK_ONLY)
    # one row for each model and pass, which is a task of its own
    groups = sorted(map(tuple, each.select(*group).distinct().collect()))
    numbers = each.sparkSession.createDataFrame([(*g, i) for i, g in enumerate(groups)], "model_id string, pass_ string, task int")
    dealt = each.join(F.broadcast(numbers), group).repartitionById(max(1, len(groups)), "task").sortWithinPartitions(*group, "doc")
    return dealt.select(*group, "gt_phi_chars", "char_tp").mapInArrow(_choices(resamples, seed, alpha), "model_id string, pass_ string, notes long, recall double, low double, high double")


#: The prime below 2^31 up to which weights are drawn.
PRIME = (1 << 31) - 1
#: Numbers under which a draw has weight 0, 1, 2, ...: the Poisson distribution of mean 1, scaled to PRIME.
POISSON = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))
#: Notes whose weights are drawn at once.
NOTES_AT_ONCE = 128


def draw_numbers(seed: int, resamples: int) -> np.ndarray:
    """Four coefficients below PRIME for each resample."""
    found = [hashlib.md5(f"{seed}-{b}".encode()).hexdigest() for b in range(resamples)]
    return np.array([[int(h[8 * i : 8 * i + 8], 16) % PRIME for i in range(4)] for h in found], np.int64).reshape(-1, 4)


def note_numbers(docs: Sequence[str]) -> np.ndarray:
    """A number below PRIME for each note."""
    return np.array([int(hashlib.md5(d.encode()).hexdigest()[:8], 16) % PRIME for d in docs], np.int64)


def weights(notes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """How often each resample takes each note: Poisson(1), four notes' weights being independent."""
    x, out = notes[:, None], numbers[None, :, 0]
    for i in range(1, 4):
        out = (out * x + numbers[None, :, i]) % PRIME
    return np.searchsorted(np.array(POISSON), out, "right")


def _resampled(resamples: int, seed: int):
    """A task's sums for each group and resample: (model_id, pass_, b, gt, tp)."""

    def run(batches):
        numbers, sums = draw_numbers(seed, resamples), {}
        for pdf in batches:
            for at in range(0, len(pdf), NOTES_AT_ONCE):
                part = pdf.iloc[at : at + NOTES_AT_ONCE]
                docs, which = np.unique(part["doc"].to_numpy(str), return_inverse=True)
                drawn = weights(note_numbers(docs.tolist()), numbers).astype(np.float64)
                for key, own in part.groupby(["model_id", "pass_"], sort=False).indices.items():
                    both = part[["gt_phi_chars", "char_tp"]].to_numpy(np.float64)[own]
                    # whole numbers, and few enough to stay exact
                    made = (drawn[which[own]].T @ both).astype(np.int64)
                    sums[key] = sums[key] + made if key in sums else made
        for (model, pass_), made in sums.items():
            yield pd.DataFrame({"model_id": model, "pass_": pass_, "b": np.arange(resamples), "gt": made[:, 0], "tp": made[:, 1]})

    return run


def bootstrap(per_document: DataFrame, resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED, alpha: float = ALPHA) -> DataFrame:
    """Percentile intervals of pooled recall by Poisson weights: every resample takes each note 0, 1, 2, ... times.

    per_document(model_id, pass_, doc, gt_phi_chars, char_tp). A note's weights follow from its name and the resample's number
    alone, so each task sums its own notes for all resamples and only these sums move: as many for any number of
    notes. Weights are values of a random cubic polynomial modulo a prime at the note's number, through the
    distribution's inverse; so they can be drawn in SQL as well, and any four notes' are independent. Notes
    without gold characters weigh on neither sum and are left out.
    """
    group = ["model_id", "pass_"]
    each = per_document.select(*group, F.col("doc").cast("string").alias("doc"), F.col("gt_phi_chars").cast("long").alias("gt_phi_chars"), F.col("char_tp").cast("long").alias("char_tp"))
    sums = each.groupBy(*group).agg(F.count("*").alias("n"), F.sum("char_tp").alias("tp"), F.sum("gt_phi_chars").alias("gt"))
    drawn = each.where("gt_phi_chars > 0").mapInPandas(_resampled(resamples, seed), "model_id string, pass_ string, b int, gt long, tp long")
    recalls = drawn.groupBy(*group, "b").agg(F.try_divide(F.sum("tp").cast("double"), F.sum("gt").cast("double")).alias("r"))
    # one number for each resample
    bounds = recalls.groupBy(*group).agg(F.percentile("r", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return sums.join(bounds, group, "left").select(*group, F.col("n").alias("notes"), F.try_divide(F.col("tp").cast("double"), F.col("gt").cast("double")).alias("recall"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
