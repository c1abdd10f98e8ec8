import os
import time

import pytest
from pyspark.sql import functions as F

from maskline.functions.constants import PASSES
from maskline.operators.extract import PatternExtractor
from maskline.plans.deidentify import deidentify
from maskline.sources import readers, sinks, tree
from maskline.streaming.notes import note_stream

from .fixture import NAMES, frames


def _notes(folder, texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
            f.write(text)


def test_empty_notes_have_rows(spark, tmp_path):
    _notes(f"{tmp_path}/n", {"A.txt": "a\r\nb\rc\n", "B.txt": "", "C.txt": "\r\n", "other.md": "x"})
    os.makedirs(f"{tmp_path}/n/sub.txt")
    got = readers.read_notes(spark, f"{tmp_path}/n")
    assert {r.doc_id: r.text for r in got.collect()} == {"A": "a\nb\nc\n", "B": "", "C": "\n"}
    run = deidentify(got.withColumn("model_id", F.lit("m")), PatternExtractor(NAMES))
    assert {(r.doc_id, r["pass"]) for r in run.responses.collect()} == {(d, p) for d in "ABC" for p in PASSES}
    _notes(f"{tmp_path}/bad", {"a b.txt": ""})
    with pytest.raises(Exception, match="bad document id"):
        readers.read_notes(spark, f"{tmp_path}/bad").collect()
    with pytest.raises(FileNotFoundError):
        readers.read_notes(spark, f"{tmp_path}/none")


def test_only_notes_that_are_asked_for_are_opened(spark, tmp_path):
    """A bad name would be an error if its file were opened."""
    _notes(f"{tmp_path}/n", {"A.txt": "a", "B.txt": "", "bad name.txt": ""})
    got = tree.notes(spark, f"{tmp_path}/n").where(F.col("doc_id").isin("A", "B"))
    assert sorted(r.doc_id for r in got.collect()) == ["A", "B"]
    assert tree.notes(spark, f"{tmp_path}/n").where("doc_id = 'B' and length(text) = 0").count() == 1
    assert tree.notes(spark, f"{tmp_path}/n").where("doc_id = 'Z'").count() == 0


@pytest.mark.parametrize("files", [1, 2000])
def test_stream_of_notes(spark, tmp_path, monkeypatch, files):
    """New and changed files come once each, empty ones too, over restarts."""
    monkeypatch.setattr(tree, "FILES", files)

    def arrived():
        seen = f"{tmp_path}/seen"
        note_stream(spark, f"{tmp_path}/n").writeStream.format("parquet").option("path", seen).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.doc_id, r.text) for r in spark.read.schema("doc_id string, text string").parquet(seen).collect())

    _notes(f"{tmp_path}/n", {"A.txt": "a\r\n", "B.txt": ""})
    assert arrived() == [("A", "a\n"), ("B", "")]
    assert arrived() == [("A", "a\n"), ("B", "")]
    time.sleep(0.05)
    _notes(f"{tmp_path}/n", {"C.txt": "", "A.txt": "new"})
    assert arrived() == [("A", "a\n"), ("A", "new"), ("B", ""), ("C", "")]


def test_tree_is_pruned_to_what_is_asked_for(spark, tmp_path):
    notes, _, _ = frames(spark)
    for model in ("m1", "m2"):
        run = deidentify(notes.withColumn("model_id", F.lit(model)), PatternExtractor(NAMES))
        sinks.write_tree(f"{tmp_path}/t", run.notes, run.responses, run.validations, run.spans)
    whole = readers.read_predictions(spark, f"{tmp_path}/t")
    rows = set(map(tuple, whole.collect()))
    assert {r[0] for r in rows} == {"m1", "m2"} and {r[1] for r in rows} == set(PASSES)
    one = whole.where(f"model_id = 'm1' and pass = '{PASSES[1]}' and doc_id in ('N1', 'N3')")
    want = {r for r in rows if r[0] == "m1" and r[1] == PASSES[1] and r[2] in ("N1", "N3")}
    assert set(map(tuple, one.collect())) == want
    # what is left out is not opened: it may be unreadable
    broken = f"{tmp_path}/t/m2/resolved/N1/resolved_predictions.json"
    os.remove(broken)
    os.symlink(f"{tmp_path}/nowhere", broken)
    os.chmod(f"{tmp_path}/t", 0o755)
    assert set(map(tuple, one.collect())) == want
    reader = tree.RunReader(f"{tmp_path}/t")
    list(reader.pushFilters([tree.EqualTo(("model_id",), "m1"), tree.EqualTo(("kind",), "resolved"), tree.In(("doc_id",), ("N1", "N3", "N9"))]))
    assert [(p.model, p.number, p.kind, p.notes) for p in reader.partitions()] == [("m1", 0, "resolved", ("N1", "N3")), ("m1", 1, "resolved", ("N1", "N3"))]


def _files(folder):
    return {os.path.relpath(f"{d}/{x}", folder) for d, _, names in os.walk(folder) for x in names}


def test_a_failed_job_leaves_no_half_tree(spark, tmp_path):
    out = f"{tmp_path}/t"
    good = spark.createDataFrame([(f"m/resolved/N{i}/x.json", '{"b": 1, "a": "é"}') for i in range(8)], "path string, value string").repartition(4)
    assert sinks.write_files(good, out) == 8
    before = _files(out)
    assert before == {f"m/resolved/N{i}/x.json" for i in range(8)}
    with open(f"{out}/m/resolved/N0/x.json", encoding="utf-8") as f:
        assert f.read() == '{\n  "a": "é",\n  "b": 1\n}\n'
    bad = good.withColumn("path", F.replace("path", F.lit("N"), F.lit("M"))).unionByName(spark.createDataFrame([("m/resolved/bad/x.json", "no json")], "path string, value string"))
    with pytest.raises(Exception):
        sinks.write_files(bad, out)
    assert _files(out) == before
    with pytest.raises(Exception, match="not a path below"):
        sinks.write_files(spark.createDataFrame([("../x", "1")], "path string, value string"), out)
    assert _files(out) == before and not os.path.exists(f"{tmp_path}/x")
    # a later job adds to folders that are there, and replaces files
    more = spark.createDataFrame([("m/resolved/N1/x.json", "2"), ("m/resolved/N1/y.json", "3"), ("m/pass_2/z.json", "4")], "path string, value string")
    assert sinks.write_files(more, out) == 3
    assert _files(out) == before | {"m/resolved/N1/y.json", "m/pass_2/z.json"}
    with open(f"{out}/m/resolved/N1/x.json") as f:
        assert f.read() == "2\n"
    assert sinks.write_files(good.limit(0), out) == 0
