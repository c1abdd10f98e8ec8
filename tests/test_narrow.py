import pytest
from pyspark.sql import functions as F

from maskline.functions.text import words
from maskline.operators import narrow, score, spans
from maskline.operators.extract import pattern_pairs
from maskline.plans.deidentify import kept_on_disk


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_rows_in_two(spark, monkeypatch, most):
    monkeypatch.setattr(narrow, "BROADCAST_KEYS", most)
    rows = spark.range(100).select((F.col("id") % 50).alias("a"), F.lit("x").alias("b"))
    given = spark.createDataFrame([(3, "x"), (3, "x"), (7, "x"), (9, "y")], "a long, b string")
    own, others = narrow.parted(rows, given, ("a", "b"))
    assert sorted(r.a for r in own.collect()) == [3, 3, 7, 7] and others.count() == 96
    assert narrow.narrowed(rows, given.where("false"), ("a", "b")).count() == 0


def test_texts_without_literals_or_regions_do_not_move(spark):
    """A shuffle of notes comes after they are narrowed to those that something is found in."""
    notes = spark.range(200).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"), F.when(F.col("id") == 7, "see here").otherwise("nothing").alias("text"))
    pairs = spark.createDataFrame([("d7", "here", "01_NAME")], "doc_id string, exact_text string, identifier_type string")
    found = spans.ground(pairs, notes, ["doc_id"])
    assert "BroadcastHashJoin" in _plan(found) and "LeftSemi" in _plan(found)
    assert [tuple(r) for r in found.collect()] == [("d7", 4, 8, "01_NAME")]
    done = spans.neutral(notes, spans.regions(found, ["doc_id"]), ["doc_id"])
    assert "LeftAnti" in _plan(done)
    got = {r.doc_id: r.neutral_text for r in done.collect()}
    assert len(got) == 200 and got["d8"] == "nothing" and got["d7"].startswith("see ") and "here" not in got["d7"]


def test_kept_tables_are_read_by_column(spark):
    kept = kept_on_disk(spark.range(9).select("id", F.lit("long text").alias("text"), F.lit(None).cast("string").alias("none")), "x")
    assert kept.columns == ["id", "text", "none"] and kept.count() == 9 and kept.where("none is null").count() == 9
    plan = _plan(kept.select("id"))
    assert "FileScan parquet [id" in plan and "text" not in plan.split("ReadSchema")[1]


def test_notes_without_spans_are_not_swept(spark):
    """All notes have a row; those without spans have zeros, repeated rows of the universe count once."""
    universe = spark.createDataFrame([("m", p, d) for p in "ab" for d in (1, 1, 2, 3, 4)], "model_id string, pass string, doc_id long")
    docs = spark.createDataFrame([(1, 20), (2, 30), (3, 0), (5, 9)], "doc_id long, n_chars int")
    gold = spark.createDataFrame([(1, 0, 2, 6, "01_NAME"), (5, 0, 0, 3, "01_NAME")], "doc_id long, span_no int, start int, end int, code string")
    said = spark.createDataFrame([("m", "a", 1, 4, 9, "01_NAME"), ("m", "b", 2, 0, 40, "03_DATE"), ("m", "a", 5, 0, 3, "01_NAME")], "model_id string, pass string, doc_id long, start int, end int, identifier_type string")
    got = {(r["pass"], r.doc_id): r for r in score.document_scores(universe, docs, gold, said).collect()}
    assert set(got) == {(p, d) for p in "ab" for d in (1, 2, 3)}
    of = lambda k, *c: tuple(got[k][x] for x in c)
    assert of(("a", 1), "doc_chars", "gt", "pred_chars", "tp", "fp", "fn", "tn", "residual", "spans", "any", "full", "pred_span_count") == (20, 4, 5, 2, 3, 2, 13, 2, 1, 1, 0, 1)
    assert of(("b", 1), "gt", "pred_chars", "tp", "spans", "any", "pred_span_count") == (4, 0, 0, 1, 0, 0)
    assert of(("b", 2), "doc_chars", "gt", "pred_chars", "tn", "pred_span_count", "relaxed_pred") == (30, 0, 30, 0, 1, 0)
    assert of(("a", 3), "doc_chars", "gt", "pred_chars", "tn", "spans") == (0, 0, 0, 0, 0)
    counts = {(r["pass"], r.doc_id): r for r in score.char_counts(universe, docs, gold, said).collect()}
    assert {k: tuple(v) for k, v in counts.items()} == {k: tuple(v[c] for c in counts[k].asDict()) for k, v in got.items()}


def test_needed_text_and_words(spark):
    df = spark.createDataFrame([("a@b.org c@d.org",), ("no address",), ("",), (None,)], "t string")
    find = lambda *needed: [r[0] for r in df.select(pattern_pairs(F.col("t"), (("07_EMAIL_ADDRESS", "[a-z]+@[a-z.]+", *needed),))).collect()]
    assert find()[:3] == find("@")[:3] and [x.exact_text for x in find("@")[0]] == ["a@b.org", "c@d.org"]
    assert find("#")[0] == []
    odd = spark.createDataFrame([(" a b  c\n",), ("",), ("  ",), (None,)], "t string")
    assert [r[0] for r in odd.select(words(F.col("t"))).collect()] == [3, 0, 0, None]
