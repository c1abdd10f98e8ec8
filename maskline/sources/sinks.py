"""Writers of tables and of the compatible file tree."""

from __future__ import annotations

import json
import math
import platform

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import COHORTS, METRICS, PASSES, PREDICTIONS_VERSION, TOLERANCE
from ..operators.spans import resolved_documents
from ..operators.validate import without_content
from . import tree


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, partitioned by model and pass where they are there."""
    df.write.mode("overwrite").partitionBy(*(by or [c for c in ("model_id", "pass") if c in df.columns])).parquet(path)


def _cell(df: DataFrame, name: str) -> Column:
    return F.initcap(F.col(name).cast("string")).alias(name) if dict(df.dtypes)[name] == "boolean" else F.col(name)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; null is an empty cell, booleans are True and False."""
    df.select(*[_cell(df, c) for c in df.columns]).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session may use its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def write_files(df: DataFrame, folder: str, pretty: bool = True, packed: int = 0) -> int:
    """df(path, value): each value, JSON if pretty and then with sorted keys, as the file folder/path; returns how many.

    folder is a path or URI that all executors see; a job that fails leaves no file there. packed: how many last parts of a path
    name a file in an archive; 0 for files by themselves.
    """
    seen = Observation()
    tree.write_files(df.observe(seen, F.count("*").alias("n")), folder, pretty, packed)
    return seen.get["n"]


def resolved_json(docs: DataFrame) -> DataFrame:
    """Resolved-prediction documents as JSON text."""
    fields = sorted(c for c in docs.columns if c not in ("model_id", "pass", "doc_id"))
    return docs.select("model_id", "doc_id", F.to_json(F.struct(*[F.col(c) for c in fields], F.col("doc_id").cast("string").alias("document_id"))).alias("value"))


def envelope(responses: DataFrame) -> Column:
    """A response as its chat-completion envelope; what is null is left out."""
    # Names in the envelope.
    message = F.struct(F.lit("assistant").alias("role"), "content")
    choice = F.struct(F.lit(0).alias("index"), "finish_reason", message.alias("message"))
    usage = F.struct("prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    return F.struct(F.array(choice).alias("choices"), usage.alias("usage"), F.col("model_id").alias("model"), F.lit("chat.completion").alias("object"), "transport_error", "latency_seconds")


def write_tree(folder: str, notes: DataFrame, responses: DataFrame, validations: DataFrame, found: DataFrame, strip_content: bool = False, packed: bool = False) -> int:
    """A run's tables as the tree of files that the readers read: Pass 1 in the model's folder, Pass 2 in its pass_2.

    packed: note folders are packed into archives, for runs of many notes.
    """
    at = F.concat("model_id", F.when(F.col("pass") == PASSES[1], "/pass_2").otherwise(""))
    scope = F.concat(F.when(F.col("pass") == PASSES[1], "P2-").otherwise("P1-"), F.col("segment_id"))
    whole = envelope(responses)
    raw = responses.select(F.concat(at, F.lit("/raw_responses/"), "doc_id", F.lit("/"), scope, F.lit(".raw.json")).alias("path"), F.to_json(without_content(whole) if strip_content else whole).alias("value"))
    record = F.struct(F.col("doc_id").cast("string").alias("document_id"), scope.alias("scope_id"), "envelope_usable", "strict_schema_valid", "finish_reason", "contains_literal_text")
    seen = validations.select(F.concat(at, F.lit("/validation/"), "doc_id", F.lit("/"), scope, F.lit(".validation.json")).alias("path"), F.to_json(record).alias("value"))
    files = raw.unionByName(seen)
    for p in PASSES:
        docs = resolved_documents(notes, found.where(F.col("pass") == p).select("model_id", "doc_id", "start", "end", "identifier_type"), ("model_id", "doc_id"), PREDICTIONS_VERSION)
        docs = resolved_json(docs).withColumn("pass", F.lit(p))
        files = files.unionByName(docs.select(F.concat(at, F.lit("/resolved/"), "doc_id", F.lit("/resolved_predictions.json")).alias("path"), "value"))
    return write_files(files, folder, packed=2 if packed else 0)


def write_gold(records: DataFrame, folder: str, packed: bool = False) -> int:
    """Gold records as <doc_id>.json files; packed into archives for many of them."""
    fields = [c for c in records.columns if c != "doc_id"]
    return write_files(records.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(*fields)).alias("value")), folder, packed=1 if packed else 0)


def run_manifest(metrics: DataFrame, per_document: DataFrame, gold_source: str, version: str = "0.1") -> str:
    """The run's manifest as JSON."""
    models = [r.model_id for r in metrics.select("model_id").distinct().orderBy("model_id").collect()]
    # Keys of the manifest, and the definitions that it states.
    return json.dumps({
        "code_version": version, "python_version": platform.python_version(), "platform": platform.platform(), "gold_source": gold_source,
        "offset_unit": "Unicode codepoint; half-open [start,end)", "reference_text": "text of the gold records", "models": models, "n_models": len(models),
        "cohorts": [f"{COHORTS[0]} (all notes; without output a note is missed in full)", f"{COHORTS[1]} (notes of which all windows finished and, if validated, were usable)"],
        "passes": [PASSES[0], f"{PASSES[1]} (Pass 1 united with Pass 2)"], "surfaces": ["final (redaction from the resolved predictions)"],
        "recall_definition": "gold characters under any redaction / gold characters, whatever the category",
        "span_recall": ["any_span (a character or more is covered)", "full_span (all are)", "strict (equal bounds)", f"relaxed (both bounds within {TOLERANCE} codepoints)"],
        "entity_relaxed_tolerance": TOLERANCE, "averaging": "micro by default (counts are summed, then divided); *_macro is the mean of per-note rates",
        "n_cols_metrics_long": len(METRICS), "n_rows_metrics_long": metrics.count(), "n_rows_per_doc": per_document.count(),
    }, indent=2) + "\n"


def _text(value) -> str:
    return "-" if value is None else f"{value:.3f}" if isinstance(value, float) else "yes" if value is True else "" if value is False else str(value)


def fixed_width(df: DataFrame) -> str:
    """A report table (a row for each model) as text, the first two columns to the left."""
    rows = [[_text(v) for v in r] for r in df.collect()]
    widths = [max(len(x) for x in col) for col in zip(df.columns, *rows)] if rows else [len(c) for c in df.columns]
    line = lambda cells: "  ".join(c.ljust(w) if i < 2 else c.rjust(w) for i, (c, w) in enumerate(zip(cells, widths)))
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])


def markdown(df: DataFrame) -> str:
    rows = [[_text(v) for v in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [df.columns, ["---"] * len(df.columns), *rows])


_COLORS = ("#4269d0", "#efb118", "#3ca951", "#ff725c", "#a463f2")


def _clean(text) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def ticks(most: float) -> list[float]:
    """Round numbers from 0 to `most` or a little over it, four to ten of them."""
    most = most if most > 0 else 1.0
    power = 10.0 ** math.floor(math.log10(most))
    step = next(s * power for s in (0.1, 0.2, 0.25, 0.5, 1.0, 2.0) if most / (s * power) <= 9)
    return [round(i * step, 10) for i in range(math.ceil(most / step - 1e-9) + 1)]


class _Plot:
    """A plane with labelled scales; numbers in, SVG out."""

    def __init__(self, title: str, most_x: float | None, most_y: float, width: int, x: str = "", y: str = ""):
        self.left, self.top, self.width, self.height = 60, 40, width, 300
        self.x, self.y = ticks(most_x) if most_x is not None else [], ticks(most_y)
        self.out = [f'<text x="10" y="20" font-size="14">{_clean(title)}</text>']
        for v in self.y:
            at = self.at(0, v)[1]
            self.out.append(f'<line x1="{self.left}" y1="{at:.1f}" x2="{self.left + width}" y2="{at:.1f}" stroke="#ddd"/><text x="{self.left - 6}" y="{at + 3:.1f}" font-size="9" text-anchor="end">{v:g}</text>')
        bottom = self.top + self.height
        for v in self.x:
            at = self.at(v, 0)[0]
            self.out.append(f'<line x1="{at:.1f}" y1="{bottom}" x2="{at:.1f}" y2="{bottom + 4}" stroke="black"/><text x="{at:.1f}" y="{bottom + 15}" font-size="9" text-anchor="middle">{v:g}</text>')
        self.out.append(f'<path d="M{self.left} {self.top}V{bottom}H{self.left + width}" fill="none" stroke="black"/>')
        self.out.append(f'<text x="{self.left + width / 2:.0f}" y="{bottom + 32}" font-size="11" text-anchor="middle">{_clean(x)}</text><text x="14" y="{self.top + self.height / 2:.0f}" font-size="11" text-anchor="middle" transform="rotate(-90 14 {self.top + self.height / 2:.0f})">{_clean(y)}</text>')

    def at(self, x: float, y: float) -> tuple[float, float]:
        return self.left + (self.width * x / self.x[-1] if self.x else x), self.top + self.height * (1 - y / self.y[-1])

    def svg(self) -> str:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.left + self.width + 140}" height="{self.top + self.height + 80}">{"".join(self.out)}</svg>'


def bar_chart(df: DataFrame, title: str, label: str = "model_id") -> str:
    """A small report table's numbers as grouped bars over a scale, with a legend, in SVG; a missing number has no bar."""
    rows, series = df.collect(), [c for c in df.columns if c != label]
    group = 14 * len(series) + 20
    most = max([1e-9, *(float(r[c]) for r in rows for c in series if r[c] is not None)])
    plot = _Plot(title, None, most, max(1, len(rows)) * group + 20)
    for i, r in enumerate(rows):
        for k, c in enumerate(series):
            if r[c] is not None:
                x, y = plot.at(20 + i * group + 14 * k, max(0.0, float(r[c])))
                plot.out.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="12" height="{plot.top + plot.height - y:.1f}" fill="{_COLORS[k % len(_COLORS)]}"><title>{_clean(r[label])}, {_clean(c)}: {float(r[c]):g}</title></rect>')
        x = plot.at(20 + i * group + 7 * len(series), 0)[0]
        plot.out.append(f'<text x="{x:.1f}" y="{plot.top + plot.height + 14}" font-size="9" text-anchor="middle">{_clean(r[label])}</text>')
    for k, c in enumerate(series):
        x, y = plot.left + plot.width + 10, plot.top + 16 * k
        plot.out.append(f'<rect x="{x}" y="{y}" width="10" height="10" fill="{_COLORS[k % len(_COLORS)]}"/><text x="{x + 14}" y="{y + 9}" font-size="9">{_clean(c)}</text>')
    return plot.svg()


def scatter_chart(df: DataFrame, title: str, x: str, y: str, label: str = "model_id") -> str:
    """A small report table's rows as labelled points over two scales, in SVG; rows without both numbers are left out."""
    rows = [(r[label], float(r[x]), float(r[y])) for r in df.collect() if r[x] is not None and r[y] is not None]
    most_x, most_y = (max([1e-9, *(r[i] for r in rows)]) for i in (1, 2))
    plot = _Plot(title, most_x, most_y, 500, x, y)
    for name, a, b in rows:
        px, py = plot.at(a, b)
        plot.out.append(f'<circle cx="{px:.1f}" cy="{py:.1f}" r="4" fill="{_COLORS[0]}"/><text x="{px + 6:.1f}" y="{py - 4:.1f}" font-size="9">{_clean(name)}</text>')
    return plot.svg()
