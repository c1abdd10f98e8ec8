import json

import pytest

from maskline import cli
from maskline.operators.extract import ServerExtractor
from maskline.sources import readers, sinks

from .fixture import NAMES, NOTES, gold_rows


def _tree(top):
    notes, gold = top / "notes", top / "gold"
    notes.mkdir()
    gold.mkdir()
    for k, v in NOTES.items():
        (notes / f"{k}.txt").write_bytes(v.replace("\n", "\r\n").encode())
        spans = [x for x in gold_rows() if x[0] == k]
        (gold / f"{k}.json").write_text(json.dumps({"text": v, "denotations": [{"id": f"T{n}", "obj": "X", "span": {"begin": a, "end": b}} for _, n, a, b, _ in spans], "attributes": [{"id": f"A{n}", "subj": f"T{n}", "pred": "identifier_type", "obj": c} for _, n, _, _, c in spans]}))
    (top / "names.txt").write_text("\n".join([*NAMES, " ", ""]))


def test_run_score_and_report(spark, tmp_path, capsys):
    _tree(tmp_path)
    t = str(tmp_path)
    cli.main(["run", "--notes-dir", f"{t}/notes", "--out-dir", f"{t}/out", "--offline-stub", "--name-file", f"{t}/names.txt", "--json-tree", f"{t}/tree"])
    cli.main(["score", "--pred-dir", f"{t}/out", "--gold-dir", f"{t}/gold", "--out-dir", f"{t}/res"])
    cli.main(["score", "--pred-dir", f"{t}/tree", "--json-tree", "--gold-dir", f"{t}/gold", "--out-dir", f"{t}/again"])
    named = (tmp_path / "tree/offline-stub/pass_2/raw_responses/N1/P2-S0001.raw.json").read_text()
    assert named.startswith('{\n  "choices"') and json.loads(named)["object"] == "chat.completion"
    record = json.loads((tmp_path / "tree/offline-stub/resolved/N1/resolved_predictions.json").read_text())
    assert record["document_id"] == "N1" and record["contains_literal_text"] is False and record["predictions"]
    first, second = (sorted(map(str, readers.read_results(spark, f"{t}/{x}/metrics_long").drop("developer", "family", "hf_link").collect())) for x in ("res", "again"))
    assert first == second
    m = readers.read_results(spark, f"{t}/res/metrics_long")
    assert m.count() == 32 and len(m.columns) == 69
    gold = list(gold_rows())
    caught = sum(b - a for _, _, a, b, c in gold if not c.startswith("02"))
    r = m.where("phi_type = 'ALL' and pass = 'cumulative_pass2' and cohort = 'all_expected'").head()
    assert r.char_tp == caught and r.char_fp == 0
    cli.main(["report", "results", "--source", f"{t}/res/metrics_long", "--svg", f"{t}/a.svg"])
    assert "offline-stub" in capsys.readouterr().out and (tmp_path / "a.svg").read_text().startswith("<svg")


def test_gold_rules(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"text": "x" * 9, "denotations": [{"id": "T1", "span": {"begin": 0, "end": 2}}, {"id": "T2", "spans": [{"begin": 3, "end": 4}]}, {"id": "T3"}], "attributes": [{"subj": "T1", "pred": "identifier_type", "obj": "01_NAME"}, {"subj": "T1", "pred": "other", "obj": "zz"}, {"subj": "T1", "pred": "identifier_type", "obj": "03_DATE"}]}))
    docs, gold = readers.read_gold(spark, str(tmp_path))
    assert docs.head().n_chars == 9
    assert {(r.start, r.end, r.code) for r in gold.collect()} == {(0, 2, "03_DATE"), (3, 4, "UNKNOWN")}


def test_file_tree_of_a_run(spark, tmp_path):
    base = tmp_path / "m"
    for p, spans in (("resolved/d", [{"start": 0, "end": 3, "identifier_type": "01_NAME"}, {"start": None, "end": 3, "identifier_type": "x"}]), ("pass_2/resolved/d", None)):
        (base / p).mkdir(parents=True)
        (base / p / "resolved_predictions.json").write_text("{broken" if spans is None else json.dumps({"predictions": spans}))
    (base / "raw_responses/d").mkdir(parents=True)
    (base / "raw_responses/d/P1-S0001.raw.json").write_text(json.dumps({"choices": [{"finish_reason": "stop"}], "usage": {"prompt_tokens": 5}}))
    (base / "pass_2/raw_responses/d").mkdir(parents=True)
    (base / "pass_2/raw_responses/d/P2-S0001.raw.json").write_text("nonsense")
    (base / "pass_2/raw_responses/d/P2-S0002.raw.json").write_text(json.dumps({"choices": [{"finish_reason": "length"}], "usage": {"completion_tokens": 3}}))
    (base / "pass_2/raw_responses/d/P1-S0001.raw.json").write_text(json.dumps({"choices": [{"finish_reason": "stop"}]}))
    (base / "validation/d").mkdir(parents=True)
    (base / "validation/d/P1-S0001.validation.json").write_text(json.dumps({"scope_id": "P1-S0001", "envelope_usable": True, "strict_schema_valid": False}))
    (base / "model_config.json").write_text(json.dumps({"developer": "D", "hf_gguf_repo": "a/b", "moe": False, "reasoning": True, "quant_target": "Q"}))
    out = str(tmp_path)
    assert [(r["pass"], r.start) for r in readers.read_predictions(spark, out).collect()] == [("pass1", 0)]
    assert [r.model_id for r in readers.discover_models(spark, out).collect()] == ["m"]
    r = readers.read_responses(spark, out).collect()
    assert sorted((x["pass"], x.finish_reason, x.prompt_tokens, x.completion_tokens) for x in r) == [("cumulative_pass2", "length", 0, 3), ("pass1", "stop", 5, 0)]
    v = readers.read_validations(spark, out).head()
    assert (v["pass"], v.envelope_usable, v.strict_schema_valid) == ("pass1", True, False)
    c = readers.read_configs(spark, out).head()
    assert (c.hf_link, c.is_reasoning, c.quant) == ("https://huggingface.co/a/b", True, "Q")
    assert readers.roster(spark).count() == 17


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_notes(spark, str(tmp_path))
    (tmp_path / "bad id.txt").write_text("x")
    with pytest.raises(Exception, match="bad document id"):
        readers.read_notes(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        ServerExtractor("http://x", "m", "s", "no placeholder")


def test_transport_errors_are_responses(spark):
    asked = ServerExtractor("http://127.0.0.1:9", "m", "s", "{{CLINICAL_TEXT}}", 1)
    r = asked.respond(spark.createDataFrame([("d", "t")], "doc_id string, text string")).head()
    assert (r.finish_reason, r.transport_error, r.content, r.prompt_tokens) == ("error", "URLError", "", 0)


def test_printers(spark):
    df = spark.createDataFrame([("a<b", 0.5, True), ("c", None, False)], "model_id string, r double, f boolean")
    assert "0.500" in sinks.fixed_width(df) and "| c | - |  |" in sinks.markdown(df)


def test_stream_of_notes(spark, tmp_path):
    from maskline.operators.extract import PatternExtractor
    from maskline.streaming.notes import note_stream, stream_spans

    _tree(tmp_path)
    t = str(tmp_path)
    stream_spans(note_stream(spark, f"{t}/notes"), PatternExtractor(NAMES), "m", f"{t}/spans", f"{t}/state").awaitTermination(300)
    got = spark.read.parquet(f"{t}/spans/*").where("pass = 'pass1'")
    assert got.count() == len([x for x in gold_rows() if not x[4].startswith("02")])
