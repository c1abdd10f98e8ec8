"""Readers of the file tree that a run leaves, and of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CHECKPOINTS, METRICS, PASSES
from ..operators.extract import PLACEHOLDER
from . import tree

GOLD = """sourcedb string, sourceid string, text string,
denotations array<struct<id:string,obj:string,span:struct<begin:int,end:int>,spans:array<struct<begin:int,end:int>>>>,
attributes array<struct<id:string,subj:string,obj:string,pred:string>>"""
ENVELOPE = """choices array<struct<index:int,finish_reason:string,message:struct<role:string,content:string,reasoning_content:string>>>,
usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>, model string, object string, transport_error string, latency_seconds double"""
VALIDATION = "document_id string, scope_id string, envelope_usable boolean, strict_schema_valid boolean, finish_reason string, contains_literal_text boolean"
PREDICTIONS = "schema_version string, document_id string, source_sha256 string, offset_unit string, contains_literal_text boolean, predictions array<struct<start:int,end:int,identifier_type:string>>"
CONFIG = "developer string, family string, hf_gguf_repo string, is_medical boolean, moe boolean, params_active_B double, params_total_B double, quant_target string, reasoning boolean, size_gb double"


def _part(pattern: str) -> Column:
    return F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), pattern, 1)


def _json(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Whole JSON files; what can't be parsed is null."""
    raw = spark.read.options(**options).text(path, wholetext=True)
    return raw.select("*", "_metadata", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """<doc_id>.txt files, not in subfolders, with universal newlines; an empty file is an empty note. A bad id is an error, no file too."""
    found = tree.notes(spark, folder)
    if not found.head(1):
        raise FileNotFoundError(f"no notes in {folder}")
    return found


def _tree_json(spark: SparkSession, out: str, kind: str, schema: str) -> DataFrame:
    """The files of a kind in a run's tree, parsed; what can't be parsed is null. Filters on model_id, pass and doc_id reach the listing."""
    return tree.run_files(spark, out).where(F.col("kind") == kind).withColumn("j", F.from_json("value", schema, {"mode": "PERMISSIVE"}))


def read_gold(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Gold files, packed ones too, as (doc_id, n_chars, text) and (doc_id, span_no, start, end, code)."""
    j = _json(spark, folder, GOLD, pathGlobFilter="*.json").select(_part(r"([^/]*)\.json$").alias("doc_id"), "j")
    packed = tree.packed_files(spark, folder).select(F.regexp_extract("name", r"^(.*)\.json$", 1).alias("doc_id"), F.from_json("value", GOLD, {"mode": "PERMISSIVE"}).alias("j"))
    j = j.unionByName(packed).select("doc_id", "j.*")
    docs = j.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.coalesce("text", F.lit("")).alias("text"))
    return docs, gold_spans(j)


def gold_spans(j: DataFrame) -> DataFrame:
    """Spans of parsed gold files; an annotation's last identifier_type attribute counts, none is UNKNOWN."""
    kind = j.select("doc_id", F.posexplode("attributes").alias("pos", "a")).where("a.pred = 'identifier_type'")
    kind = kind.groupBy("doc_id", F.col("a.subj").alias("id")).agg(F.max_by("a.obj", "pos").alias("code"))
    each = j.select("doc_id", F.posexplode("denotations").alias("span_no", "d"))
    span = F.coalesce("d.span", F.try_element_at("d.spans", F.lit(1)))
    each = each.select("doc_id", "span_no", F.col("d.id").alias("id"), span["begin"].alias("start"), span["end"].alias("end")).where("start is not null and end is not null")
    return each.join(kind, ["doc_id", "id"], "left").select("doc_id", "span_no", "start", "end", F.coalesce("code", F.lit("UNKNOWN")).alias("code"))


def read_predictions(spark: SparkSession, out: str) -> DataFrame:
    """Spans of both passes: (model_id, pass, doc_id, start, end, identifier_type); unreadable files have none."""
    files = prediction_files(spark, out)
    spans = files.select("model_id", "pass", "doc_id", F.explode("j.predictions").alias("p"))
    return spans.select("model_id", "pass", "doc_id", "p.*").where("start is not null and end is not null")


def prediction_files(spark: SparkSession, out: str) -> DataFrame:
    return _tree_json(spark, out, "resolved", PREDICTIONS).where("name = 'resolved_predictions.json'").select("model_id", "pass", "doc_id", "j")


def list_documents(spark: SparkSession, out: str) -> DataFrame:
    """(model_id, doc_id) of all Pass-1 files: the notes that a model has to answer for."""
    return prediction_files(spark, out).where("pass = 'pass1'").select("model_id", "doc_id").distinct()


def discover_models(spark: SparkSession, out: str) -> DataFrame:
    return list_documents(spark, out).select("model_id").distinct().orderBy("model_id")


def _scope(prefix: str) -> Column:
    """P1 or P2, by the pass, then `prefix`."""
    return F.concat(F.lit("P"), F.when(F.col("pass") == PASSES[0], "1").otherwise("2"), F.lit(prefix))


def read_responses(spark: SparkSession, out: str) -> DataFrame:
    """Raw responses: first choice's finish reason and token counts; malformed files are left out."""
    tokens = lambda c: F.coalesce(F.col(f"j.usage.{c}"), F.lit(0)).alias(c)
    rows = _tree_json(spark, out, "raw_responses", ENVELOPE).where(F.endswith("name", F.lit(".raw.json")) & F.startswith("name", _scope("-")))
    rows = rows.where("j is not null and (j.choices is not null or j.usage is not null or j.model is not null or j.object is not null)")
    return rows.select("model_id", "pass", "doc_id", F.try_element_at("j.choices", F.lit(1))["finish_reason"].alias("finish_reason"), tokens("prompt_tokens"), tokens("completion_tokens"))


def read_contents(spark: SparkSession, out: str) -> DataFrame:
    """What raw responses hold besides counts: (model_id, pass, doc_id, segment_id, content, has_reasoning)."""
    rows = _tree_json(spark, out, "raw_responses", ENVELOPE).where(F.endswith("name", F.lit(".raw.json")) & F.startswith("name", _scope("-")))
    message = F.try_element_at("j.choices", F.lit(1))["message"]
    return rows.select("model_id", "pass", "doc_id", F.regexp_extract("name", r"^P[12]-(.*)\.raw\.json$", 1).alias("segment_id"), message["content"].alias("content"), F.contains("value", F.lit('"reasoning_content"')).alias("has_reasoning"))


def read_validations(spark: SparkSession, out: str) -> DataFrame:
    """Validation records whose scope id begins with the pass."""
    rows = _tree_json(spark, out, "validation", VALIDATION).where(F.endswith("name", F.lit(".validation.json")) & F.startswith("j.scope_id", _scope("")))
    return rows.select("model_id", "pass", "doc_id", F.col("j.envelope_usable").alias("envelope_usable"), F.col("j.strict_schema_valid").alias("strict_schema_valid"))


def config_columns(j: DataFrame) -> DataFrame:
    """Model dimensions from parsed configurations (model_id, CONFIG fields)."""
    repo = F.coalesce("hf_gguf_repo", F.lit(""))
    return j.select("model_id", F.when(repo != "", F.concat(F.lit("https://huggingface.co/"), repo)).otherwise("").alias("hf_link"), repo.alias("hf_gguf_repo"), "developer", "family", "params_total_B", "params_active_B", "moe", "is_medical", F.col("reasoning").alias("is_reasoning"), F.col("quant_target").alias("quant"))


def read_configs(spark: SparkSession, out: str) -> DataFrame:
    """model_config.json of each model's folder; broken ones are blank."""
    return config_columns(_tree_json(spark, out, "config", CONFIG).select("model_id", "j.*"))


def roster(spark: SparkSession) -> DataFrame:
    """Dimensions of the study's checkpoints."""
    names = "model_id model developer family params_total_B params_active_B moe is_medical quant_target size_gb hf_gguf_repo".split()
    rows = [tuple(x or None for x in line.split("|")) for line in CHECKPOINTS.split("\n")[1:-1]]
    given = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    kinds = {"params_total_B": "double", "params_active_B": "double", "size_gb": "double", "moe": "boolean", "is_medical": "boolean"}
    return config_columns(given.select(*[F.col(n).cast(kinds.get(n, "string")).alias(n) for n in names], F.lit(False).alias("reasoning")))


def _lines(spark: SparkSession, path: str) -> list[str]:
    return [r.value for r in spark.read.text(path).collect()]


def read_protocol(spark: SparkSession, folder: str) -> tuple[str, str]:
    """System prompt and user template; the template needs its placeholder exactly once."""
    system, template = ("\n".join(_lines(spark, f"{folder}/{n}.txt")) for n in ("system_prompt", "user_prompt_template"))
    if template.count(PLACEHOLDER) != 1:
        raise ValueError("the user template needs the placeholder exactly once")
    return system, template


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Names, a line each, trimmed and without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def read_results(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A result table from CSV; blank and "None" are null and rates are numbers."""
    raw = spark.read.option("header", True).csv(path)
    text = {"model_id", "hf_link", "hf_gguf_repo", "developer", "family", "quant", "doc_provenance", "pass", "surface", "cohort", "phi_type", "doc", "pass_", "moe", "is_medical", "is_reasoning", "gold_types_present", "model_dir", "zero_residual", "operational_complete"}
    wanted = columns or [c for c in METRICS if c in raw.columns] or raw.columns
    clean = lambda c: F.nullif(F.nullif(F.col(c), F.lit("")), F.lit("None"))
    return raw.select(*[(clean(c) if c in text else clean(c).try_cast("double")).alias(c) for c in wanted])
