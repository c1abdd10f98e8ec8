"""Command line: run, score and report over folders."""

from __future__ import annotations

import argparse
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.constants import ALPHA, BOOTSTRAP_SEED, COHORTS, OVERLAP, PASSES, PREDICTIONS_VERSION, RESAMPLES, WINDOW
from .operators import spans
from .operators.extract import PatternExtractor, ServerExtractor
from .plans import reports
from .plans.deidentify import both_passes, deidentify, score_run
from .sources import readers, sinks


def _written(spark: SparkSession, out: str):
    """Responses are written and read again: a served model is asked once."""

    def store(df, name):
        df.write.mode("overwrite").parquet(f"{out}/work/{name}")
        return spark.read.parquet(f"{out}/work/{name}")

    return store


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    notes = readers.read_notes(spark, a.notes_dir).withColumn("model_id", F.lit(a.model_id))
    if a.offline_stub:
        extractor = PatternExtractor(readers.read_gazetteer(spark, a.name_file) if a.name_file else ())
    else:
        extractor = ServerExtractor(a.api_base, a.model_id, *readers.read_protocol(spark, a.protocol_dir), timeout=a.request_timeout, ledger=a.ledger, at_once=a.open_requests, again=a.ask_again)
    done = deidentify(notes, extractor, a.segment_size, a.overlap, _written(spark, a.out_dir))
    responses = done.responses.withColumn("content", F.lit("")) if a.strip_raw_content else done.responses
    responses = responses.drop("text") if a.strip_raw_content else responses
    for name, df in (("responses", responses), ("validations", done.validations), ("spans", done.spans)):
        sinks.write_table(df, f"{a.out_dir}/{name}")
    found = spark.read.parquet(f"{a.out_dir}/spans")
    for p in PASSES:
        docs = spans.resolved_documents(notes, found.where(F.col("pass") == p).select("model_id", "doc_id", "start", "end", "identifier_type"), ("model_id", "doc_id"), PREDICTIONS_VERSION)
        sinks.write_table(docs, f"{a.out_dir}/resolved/{p}", "model_id")
    if a.json_tree:
        sinks.write_tree(a.json_tree, notes, spark.read.parquet(f"{a.out_dir}/responses"), spark.read.parquet(f"{a.out_dir}/validations"), found, a.strip_raw_content)
        if a.model_config:
            config = spark.read.text(a.model_config, wholetext=True).select(F.lit(f"{a.model_id}/model_config.json").alias("path"), "value")
            sinks.write_files(config, a.json_tree)
    if a.model_config:
        rows = [r.value for r in spark.read.text(a.model_config, wholetext=True).collect()]
        if not rows:
            raise FileNotFoundError(a.model_config)
        sinks.write_table(spark.createDataFrame([(a.model_id, rows[0])], "model_id string, config string"), f"{a.out_dir}/model_configs")


def _there(read):
    """What read() reads, or None where there is nothing; any other error stays one."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    docs, gold = readers.read_gold(spark, a.gold_dir)
    if a.json_tree:
        tables = {"responses": readers.read_responses(spark, a.pred_dir), "validations": readers.read_validations(spark, a.pred_dir), "spans": readers.read_predictions(spark, a.pred_dir)}
        universe = both_passes(readers.list_documents(spark, a.pred_dir))
        configs = _there(lambda: readers.read_configs(spark, a.pred_dir))
    else:
        tables = {n: spark.read.parquet(f"{a.pred_dir}/{n}") for n in ("responses", "validations", "spans")}
        universe = both_passes(spark.read.parquet(f"{a.pred_dir}/resolved/{PASSES[0]}"))
        stored = _there(lambda: spark.read.parquet(f"{a.pred_dir}/model_configs"))
        configs = stored and readers.config_columns(stored.select("model_id", F.from_json("config", readers.CONFIG).alias("j")).select("model_id", "j.*"))
    out = score_run(universe, docs, gold, tables["spans"], tables["responses"], tables["validations"], configs)
    for name, df in (("metrics_long", out.metrics), ("per_doc_long", out.per_document), ("model_manifest", out.manifest)):
        sinks.write_csv(df, f"{a.out_dir}/{name}")
    manifest = sinks.run_manifest(out.metrics, out.per_document, a.gold_dir)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out_dir}/run_manifest")


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.kind == "checkpoints":
        table = reports.checkpoints(spark).orderBy("ord").drop("ord")
    elif a.kind == "corpus":
        docs, gold = readers.read_gold(spark, a.source)
        print(sinks.markdown(reports.corpus_totals(docs, gold)))
        table = reports.corpus_categories(gold)
    elif a.kind == "bootstrap":
        rows = readers.read_results(spark, a.source)
        table = reports.bootstrap_exact(rows if a.pass_ == "all" else rows.where(F.col("pass_") == a.pass_), a.resamples, a.seed, a.alpha).orderBy("model_id", "pass_")
    else:
        metrics = readers.read_results(spark, a.source)
        table = reports.ranked(metrics, a.pass_, a.cohort).orderBy("rank") if a.kind == "results" else getattr(reports, a.kind)(metrics)
    if not table.head(1):
        raise SystemExit("no rows")
    print(sinks.markdown(table) if a.kind in ("corpus", "checkpoints") else sinks.fixed_width(table))
    if a.csv:
        sinks.write_csv(table, a.csv)
    if a.svg:
        with open(a.svg, "w", encoding="utf-8") as f:
            f.write(sinks.scatter_chart(table, a.kind, *table.columns[1:3]) if a.kind in ("figure2", "figure3") else sinks.bar_chart(table, a.kind))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="maskline")
    sub = top.add_subparsers(required=True)
    r = sub.add_parser("run", help="notes to spans")
    for name, default in (("model-id", "offline-stub"), ("notes-dir", None), ("out-dir", None), ("protocol-dir", None), ("api-base", "http://127.0.0.1:8080"), ("name-file", None), ("model-config", None)):
        r.add_argument(f"--{name}", default=default, required=name in ("notes-dir", "out-dir"))
    r.add_argument("--json-tree", help="folder for the run as a tree of JSON files as well")
    r.add_argument("--offline-stub", action="store_true")
    r.add_argument("--strip-raw-content", action="store_true")
    r.add_argument("--segment-size", type=int, default=WINDOW)
    r.add_argument("--overlap", type=int, default=OVERLAP)
    r.add_argument("--request-timeout", type=float, default=600)
    r.add_argument("--ledger", help="folder of answers; a run that is started again asks only for what is not in it")
    r.add_argument("--open-requests", type=int, default=4, help="requests that a task has open at once")
    r.add_argument("--ask-again", action="store_true", help="ask again where the ledger only has errors of transport")
    r.set_defaults(do=run)
    s = sub.add_parser("score", help="spans to result tables")
    for name in ("pred-dir", "gold-dir", "out-dir"):
        s.add_argument(f"--{name}", required=True)
    s.add_argument("--json-tree", action="store_true", help="pred-dir holds the tree of JSON files of runs, not tables")
    s.set_defaults(do=score)
    t = sub.add_parser("report", help="tables and figures")
    t.add_argument("kind", choices=["results", "corpus", "checkpoints", "bootstrap", *(f"figure{i}" for i in range(2, 7))])
    t.add_argument("--source", help="folder of the result table, or of gold files")
    t.add_argument("--pass", dest="pass_", default=PASSES[1])
    t.add_argument("--cohort", default=COHORTS[0])
    t.add_argument("--resamples", type=int, default=RESAMPLES)
    t.add_argument("--seed", type=int, default=BOOTSTRAP_SEED)
    t.add_argument("--alpha", type=float, default=ALPHA)
    t.add_argument("--csv")
    t.add_argument("--svg")
    t.set_defaults(do=report)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("maskline").getOrCreate()
    a.do(spark, a)


if __name__ == "__main__":
    main()
