import random

import pytest
from pyspark.sql import functions as F

from maskline.operators import checks, score
from maskline.operators.extract import PatternExtractor
from maskline.operators.segment import check_segments, segments
from maskline.plans import changes
from maskline.plans.deidentify import both_passes, both_scores, deidentify
from maskline.streaming import scores

from .fixture import NAMES, NOTES, frames

FOUND = (("07_EMAIL_ADDRESS", r"[a-z]+@[a-z]+\.org"), ("03_DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"))


def _notes(n, salt=0):
    random.seed(n + salt)
    return {f"d{i}": " ".join(random.choice(["mail ada@birch.org", "on 2031-04-02", "no", "more words"]) for _ in range(random.randint(0, 6))) for i in range(n)}


def _frames(spark, texts):
    notes = spark.createDataFrame([("m", k, v) for k, v in texts.items()], "model_id string, doc_id string, text string")
    gold = [(k, 10 * i, a, a + 14, "07_EMAIL_ADDRESS") for k, v in texts.items() for i, a in enumerate(j for j in range(len(v)) if v.startswith("ada@birch.org", j))]
    docs = spark.createDataFrame([(k, len(v)) for k, v in texts.items()], "doc_id string, n_chars int")
    return notes, docs, spark.createDataFrame(gold, "doc_id string, span_no int, start int, end int, code string")


def _sums(spark, texts):
    notes, docs, gold = _frames(spark, texts)
    run = deidentify(notes, PatternExtractor((), FOUND))
    documents, _ = both_scores(both_passes(notes), docs, gold, run.spans)
    return documents, score.document_operations(run.responses, run.validations), run


def _plain(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_only_changed_notes_run_again(spark, tmp_path):
    texts, extractor, folder = _notes(40), PatternExtractor((), FOUND), f"{tmp_path}/v"
    assert changes.update(*_frames(spark, texts), extractor, folder) == 40
    assert changes.update(*_frames(spark, texts), extractor, folder) == 0
    texts["d3"] += " and ada@birch.org"
    texts["d7"] = ""
    del texts["d9"]
    texts["new"] = "on 2031-04-02"
    asked = []

    class Counts(PatternExtractor):
        def respond(self, windows):
            asked.append(sorted(r.doc_id for r in windows.select("doc_id").distinct().collect()))
            return super().respond(windows)

    assert changes.update(*_frames(spark, texts), Counts((), FOUND), folder) == 3
    assert asked == [["d3", "d7", "new"]] * 2  # once in each pass
    stored, (documents, operations, run) = changes.Store(spark, folder), _sums(spark, texts)
    assert stored.latest() == 2
    assert _plain(stored.read(2, "sums")) == _plain(changes.sums(documents, operations))
    assert _plain(stored.read(2, "documents")) == _plain(documents)
    assert _plain(stored.read(2, "spans")) == _plain(run.spans)
    assert _plain(stored.read(2, "digests")) == _plain(changes.digests(_frames(spark, texts)[0]))


def test_an_unfinished_version_is_none(spark, tmp_path):
    texts, folder = _notes(5), f"{tmp_path}/v"
    assert changes.Store(spark, folder).latest() is None
    changes.update(*_frames(spark, texts), PatternExtractor((), FOUND), folder)

    class Fails(PatternExtractor):
        def respond(self, windows):
            return super().respond(windows).withColumn("content", F.raise_error("stopped").cast("string"))

    texts["d1"] = "changed"
    with pytest.raises(Exception, match="stopped"):
        changes.update(*_frames(spark, texts), Fails((), FOUND), folder)
    assert changes.Store(spark, folder).latest() == 0
    assert changes.update(*_frames(spark, texts), PatternExtractor((), FOUND), folder) == 1
    assert _plain(changes.Store(spark, folder).read(1, "sums")) == _plain(changes.sums(*_sums(spark, texts)[:2]))


def test_streamed_sums_are_those_of_the_last_versions(spark, tmp_path):
    """Batches repeated, shuffled, and with older versions that come late, against a batch job."""
    schema = scores.ROW
    first, second = ({r.doc_id + r["pass"]: r for r in scores.rows_of(*_sums(spark, _notes(12, salt))[:2], version).collect()} for salt, version in ((0, 1), (5, 2)))
    random.seed(1)
    keys = sorted(first)
    batches = [[first[k] for k in keys[:14]], [second[k] for k in keys[5:9]], [first[k] for k in keys] + [first[k] for k in keys[:3]], [second[k] for k in random.sample(keys, 12)] + [first[k] for k in keys[4:10]]]
    last = {}
    for i, rows in enumerate(batches):
        random.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = scores.stream_sums(stream, f"{tmp_path}/out", f"{tmp_path}/c")
        assert query.awaitTermination(180) and query.exception() is None
        for r in rows:
            key = r.doc_id + r["pass"]
            if key not in last or r.version > last[key].version:
                last[key] = r
        now = spark.createDataFrame(list(last.values()), schema)
        want = changes.sums(now.drop("version", "complete", "segments", "stop", "usable", "valid", "prompt_tokens", "completion_tokens"), now.select(*scores.NOTE, "segments", "stop", "usable", "valid", "prompt_tokens", "completion_tokens", F.lit(True).alias("have_validation"), F.lit(0).alias("val_requests"), "complete"))
        assert _plain(scores.totals(spark, f"{tmp_path}/out")) == _plain(want), i


def test_codes_of_segments(spark):
    notes = spark.createDataFrame([("a", "x" * 9000), ("b", ""), ("c", "😀" * 3501)], "doc_id string, text string")
    cut = segments(notes, measured=True)

    def seen(rows):
        coded, observation = checks.observed_segments(rows)
        coded.count()
        return observation.get

    good = seen(cut)
    assert (good["rows"], good["expected"], good["notes"], good["chars"]) == (6, 6, 3, 12_501) and not any(good[c] for c in checks.SEGMENT_CODES)
    assert check_segments(notes, cut).count() == 0
    at = (F.col("doc_id") == "a") & (F.col("segment_id") == "S0002")
    cases = {
        "segmentation_slice_invalid": cut.withColumn("text", F.when(at, F.lit("short")).otherwise(F.col("text"))),
        "segmentation_stride_invalid": cut.withColumn("start", F.when(at, F.col("start") + 1).otherwise(F.col("start"))).withColumn("text", F.when(at, F.expr("substring(text, 2)")).otherwise(F.col("text"))),
        "segmentation_coverage_invalid": cut.withColumn("end", F.when(at, F.col("end") + 9000).otherwise(F.col("end"))).withColumn("text", F.when(at, F.rpad("text", 12_500, "x")).otherwise(F.col("text"))),
    }
    for code, rows in cases.items():
        assert seen(rows)[code] == 1
        assert [(r.doc_id, r.error_code) for r in check_segments(notes, rows).collect()] == [("a", code if code != "segmentation_coverage_invalid" else "segmentation_slice_invalid")]
    short = cut.where(~at)
    told = seen(short)
    assert told["rows"] == 5 and told["expected"] == 6
    assert [tuple(r) for r in check_segments(notes, short).collect()] == [("a", "segmentation_coverage_invalid")]


def test_bad_rows_are_parted_with_a_code(spark):
    store = lambda df, name: df.persist()
    told = lambda bad: sorted((r.error_code, r.doc_id) for r in bad.collect())
    notes = spark.createDataFrame([("ok", "text"), ("b d", "x"), (None, "x"), ("two", "x"), ("two", "y"), ("none", None)], "doc_id string, text string")
    good, bad = checks.parted(checks.note_codes(notes), store, "doc_id")
    assert [tuple(r) for r in good.collect()] == [("ok", "text")]
    assert sorted(((r.error_code, r.doc_id) for r in bad.collect()), key=str) == sorted([("document_id_invalid", "b d"), ("document_id_invalid", None), ("document_id_repeated", "two"), ("document_id_repeated", "two"), ("text_missing", "none")], key=str)
    texts = spark.createDataFrame([(d, "0123456789") for d in ("ok", "empty", "over", "cross", "touch", "bare")], "doc_id string, text string")
    marks = spark.createDataFrame([("ok", 0, 3), ("ok", 5, 10), ("empty", 2, 2), ("over", 5, 11), ("cross", 0, 3), ("cross", 2, 4), ("touch", 0, 3), ("touch", 3, 4)], "doc_id string, start int, end int")
    good, bad = checks.parted(checks.region_codes(texts, marks, ["doc_id"]), store, "doc_id")
    assert told(bad) == [("render_region_invalid", d) for d in ("cross", "empty", "over")] and good.count() == 3
    coded, seen = checks.observed(checks.gold_codes(spark.createDataFrame([("a",), ("b",)], "doc_id string"), spark.createDataFrame([("a", 3)], "doc_id string, n_chars int")), checks.GOLD_CODES)
    assert told(checks.parted(coded, store, "doc_id")[1]) == [("gold_missing", "b")] and seen.get["gold_missing"] == 1
    given = spark.createDataFrame([("ok", "345"), ("ok", ""), ("ok", "x"), ("gone", "3")], "doc_id string, exact_text string")
    assert told(checks.parted(checks.literal_codes(given, texts), store, "doc_id")[1]) == [("literal_not_found", "gone"), ("literal_not_found", "ok"), ("literal_not_found", "ok")]
