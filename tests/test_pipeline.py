import random

import pytest
from pyspark.sql import functions as F

from maskline.operators import spans, validate
from maskline.operators.extract import PatternExtractor, payload
from maskline.operators.gold import gold_records
from maskline.operators.segment import check_segments, segments
from maskline.plans import reports
from maskline.plans.deidentify import both_passes, deidentify, score_run
from maskline.sources import readers, sinks

from .fixture import GOLD, NAMES, NOTES, frames, gold_rows, starts

K = ["doc_id"]


@pytest.fixture(scope="module")
def scored(spark):
    notes, docs, gold = frames(spark)
    run = deidentify(notes.withColumn("model_id", F.lit("m")), PatternExtractor(NAMES))
    out = score_run(both_passes(run.notes), docs, gold, run.spans, run.responses, run.validations)
    return run, out


def test_golden_numbers(scored):
    _, out = scored
    rows = list(gold_rows())
    want_gt = sum(b - a for _, _, a, b, _ in rows)
    missed = sum(b - a for _, _, a, b, c in rows if c.startswith("02"))
    r = out.metrics.where("pass = 'cumulative_pass2' and cohort = 'all_expected' and phi_type = 'ALL'").head()
    assert (r.gt_phi_chars, r.char_tp, r.char_fp, r.char_fn) == (want_gt, want_gt - missed, 0, missed)
    assert r.char_precision == 1.0 and r.zero_residual_notes == 1 and r.char_recall == (want_gt - missed) / want_gt
    assert r.any_span_tp == r.strict_span_tp == r.pred_span_count == len([x for x in rows if not x[4].startswith("02")])
    assert (r.expected_requests, r.usable_rate, r.json_valid_rate, r.finish_stop_rate) == (3, 1.0, 1.0, 1.0)
    by_type = {x.phi_type: x.char_recall for x in out.metrics.where("pass = 'pass1' and cohort = 'all_expected' and phi_type <> 'ALL'").collect()}
    assert by_type.pop("02_GEOGRAPHIC_SUBDIVISION") == 0.0 and set(by_type.values()) == {1.0}
    assert out.metrics.count() == 2 * 2 * 8 and len(out.metrics.columns) == 69
    for d in out.per_document.collect():
        assert d.char_tp + d.char_fn == d.gt_phi_chars
    assert out.documents.where("tp + fp + fn + tn <> doc_chars").count() == 0
    assert out.manifest.head().gold_types_present.count(";") == 6


def test_reports(spark, scored):
    _, out = scored
    assert [r.rank for r in reports.ranked(out.metrics).collect()] == [1]
    assert reports.figure5(out.metrics).head().added_by_pass2 == 0
    assert reports.figure6(out.metrics).head().geographic == 0.0
    _, docs, gold = frames(spark)
    total = reports.corpus_totals(docs, gold).head()
    assert (total.notes, total.spans, total.categories) == (3, gold.count(), 7)
    assert reports.checkpoints(spark).count() == 17


def _percentile(values, q):
    values = sorted(values)
    k = (len(values) - 1) * q
    low = int(k)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (k - low)


def test_bootstrap_exact_against_plain_loops(spark):
    random.seed(3)
    rows = [(m, p, d, random.choice([0, 5, 9]), 0) for m in "ab" for p in "xy" for d in range(23 if m == "a" else 17)]
    rows = [(m, p, d, g, random.randint(0, g)) for m, p, d, g, _ in rows]
    df = spark.createDataFrame(rows, "model_id string, pass_ string, doc long, gt_phi_chars long, char_tp long")
    for got in reports.bootstrap_exact(df, 60, 7).collect():
        notes = [(g, t) for m, p, _, g, t in rows if (m, p) == (got.model_id, got.pass_)]
        draw = random.Random(7)
        recalls = [sum(t for _, t in s) / sum(g for g, _ in s) for s in (draw.choices(notes, k=len(notes)) for _ in range(60))]
        assert got.notes == len(notes) and got.recall == sum(t for _, t in notes) / sum(g for g, _ in notes)
        assert got.low == pytest.approx(_percentile(recalls, 0.025)) and got.high == pytest.approx(_percentile(recalls, 0.975))


def test_redacted_length(scored):
    run, _ = scored
    r = {x.doc_id: x.text for x in run.redacted.collect()}
    first = run.spans.where("pass = 'pass1'")
    size = {x.doc_id: (x.n, x.s) for x in spans.regions(first, ["model_id", "doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("s")).collect()}
    for k, t in NOTES.items():
        n, s = size[k]
        assert len(r[k]) == len(t) - s + 5 * n and r[k].count("[PHI]") == n


def test_segments(spark):
    notes = spark.createDataFrame([("a", "x" * 9000), ("b", ""), ("c", "😀" * 3501), ("d", "y" * 3500)], "doc_id string, text string")
    cut = segments(notes)
    got = {k: [(r.segment_id, r.start, r.end) for r in sorted(cut.where(F.col("doc_id") == k).collect())] for k in "abcd"}
    assert got["a"] == [("S0001", 0, 3500), ("S0002", 3100, 6600), ("S0003", 6200, 9000)]
    assert got["b"] == [("S0001", 0, 0)] and got["d"] == [("S0001", 0, 3500)] and got["c"][1] == ("S0002", 3100, 3501)
    assert check_segments(notes, cut).count() == 0
    with pytest.raises(ValueError):
        segments(notes, 10, 10)


def test_occurrences(spark):
    random.seed(1)
    rows = [(i, "".join(random.choice("ab.\\E[😀\n") for _ in range(30)), "".join(random.choice("ab.\\E[😀\n") for _ in range(random.randint(0, 3)))) for i in range(300)]
    notes = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, x, "c") for i, _, x in rows] * 2, "doc_id long, exact_text string, identifier_type string")
    got = {(r.doc_id, r.start, r.end) for r in spans.ground(pairs, notes, K).collect()}
    assert got == {(i, s, s + len(x)) for i, t, x in rows for s in starts(t, x)}


def test_gold_records(spark, tmp_path):
    notes, _, gold = frames(spark)
    given = spark.createDataFrame([(d, *p) for d, pairs in GOLD.items() for p in pairs], "doc_id string, exact_text string, identifier_type string")
    records = gold_records(notes, given, "invented")
    first = records.where("doc_id = 'N1'").head()
    assert (first.sourcedb, first.sourceid, first.denotations[0].id, first.attributes[0].subj, first.attributes[0].pred) == ("invented", "N1", "T1", "T1", "identifier_type")
    sinks.write_gold(records, f"{tmp_path}/gold")
    _, back = readers.read_gold(spark, f"{tmp_path}/gold")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, gold.collect()))
    with pytest.raises(Exception, match="literal not found"):
        gold_records(notes, given.selectExpr("doc_id", "'nowhere' AS exact_text", "identifier_type"), "x").collect()


def test_regions_touching_and_types(spark):
    s = spark.createDataFrame([("d", 0, 3, "01_NAME"), ("d", 3, 5, "03_DATE"), ("d", 4, 9, "01_NAME")], "doc_id string, start int, end int, identifier_type string")
    got = [(r.start, r.end) for r in spans.regions(s, K).orderBy("start").collect()]
    assert got == [(0, 3), (3, 9)]
    notes = spark.createDataFrame([("d", "abcdefghij"), ("e", "none")], "doc_id string, text string")
    assert {r.neutral_text for r in spans.neutral(notes, spans.regions(s, K), K).collect()} == {"[PHI][PHI]j", "none"}
    assert "[NAME][MULTIPLE_PHI:01_NAME|03_DATE]j" in {r.typed_text for r in spans.typed(notes, s, K).collect()}
    with pytest.raises(Exception, match="render_region_invalid"):
        spans.neutral(notes, s, K).collect()


def test_map_back(spark):
    notes = spark.createDataFrame([("d", "abcdefgh123ijklmnop"), ("e", "plain")], "doc_id string, text string")
    found = spans.regions(spark.createDataFrame([("d", 8, 11)], "doc_id string, start int, end int"), K)
    kept = spans.pieces(notes, found, K)
    red = spans.neutral(notes, found, K).select("doc_id", F.col("neutral_text").alias("text"))
    pairs = spark.createDataFrame([("d", "gh[PHI]ij", "01_NAME"), ("d", "ijk", "01_NAME"), ("d", "efgh", "01_NAME"), ("e", "lain", "03_DATE")], "doc_id string, exact_text string, identifier_type string")
    got = {(r.doc_id, r.start, r.end) for r in spans.map_back(spans.ground(pairs, red, K), kept, K).collect()}
    assert got == {("d", 11, 14), ("d", 4, 8), ("e", 1, 5)}


def test_validation(spark):
    good = '{"exact_text": "Ada", "identifier_type": "01_NAME"}'
    rows = [
        (0, "stop", f'{{"identifiers": [{good}, {good}, {{"exact_text": "Zed", "identifier_type": "01_NAME"}}]}}'),
        (1, "stop", '{"identifiers": [], "identifiers": []}'),
        (2, "stop", '{"identifiers": [{"exact_text": NaN, "identifier_type": "01_NAME"}]}'),
        (3, "length", f'{{"identifiers": [{good}]}}'),
        (4, "stop", f'{{"identifiers": [{good}], "more": 1}}'),
        (5, "stop", '{"identifiers": [1, {"exact_text": "Ada"}, {"exact_text": "", "identifier_type": "01_NAME"}, {"exact_text": "Ada", "identifier_type": "NOPE"}]}'),
        (6, "stop", '{"identifiers": []} x'),
        (7, None, "{}"),
        (8, "stop", '{"identifiers": [{"exact_text": "Zed", "identifier_type": "01_NAME"}]}'),
    ]
    df = spark.createDataFrame(rows, "k int, finish_reason string, content string").withColumn("text", F.lit("Ada was here"))
    v = {r.k: r for r in validate.validations(df, "k").collect()}
    usable = {k: r.envelope_usable for k, r in v.items()}
    strict = {k: r.strict_schema_valid for k, r in v.items()}
    assert usable == {0: True, 1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False, 8: True}
    assert strict == {0: False, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True}
    assert (v[0].accepted, v[0].duplicates, v[0].ungrounded, v[0].rejected) == (1, 1, 1, 1)
    assert [r.verdict for r in validate.verdicts(df, "k").where("k = 5").orderBy("pos").collect()] == ["not_object", "bad_keys", "bad_literal", "invalid_type"]
    assert v[7].finish_reason == "error"


def test_second_pass_gate(spark):
    class Half(PatternExtractor):
        """Finds digits only in redacted text, and fails on one note there."""

        def respond(self, cut):
            out = super().respond(cut)
            red = F.contains("text", F.lit("[PHI]"))
            out = out.withColumn("content", F.when(red, '{"identifiers": [{"exact_text": "77", "identifier_type": "03_DATE"}]}').otherwise(F.col("content")))
            return out.withColumn("finish_reason", F.when(red & F.contains("text", F.lit("stopped")), "length").otherwise("stop"))

    notes = spark.createDataFrame([("m", "a", "Tom Reed 77"), ("m", "b", "Tom Reed 77 stopped")], "model_id string, doc_id string, text string")
    run = deidentify(notes, Half(["Tom Reed"]))
    got = {(r.doc_id, r["pass"], r.start) for r in run.spans.collect()}
    assert got == {("a", "pass1", 0), ("b", "pass1", 0), ("a", "cumulative_pass2", 0), ("a", "cumulative_pass2", 9), ("b", "cumulative_pass2", 0)}


def test_payload():
    p = payload("m", "s", "x {{CLINICAL_TEXT}} y", "T")
    assert p["messages"][1]["content"] == "x T y" and p["seed"] == 42 and p["stream"] is False
