import random

import pytest

from maskline.operators import locate, spans
from maskline.operators.extract import PatternExtractor, gazetteer_pairs

from .fixture import starts

LETTERS = ["a", "b", "aa", "\u00e9", "\U0001f600", "\n", "(", ".*", "\\E"]


def _text(n):
    return "".join(random.choice(LETTERS) for _ in range(n))


def test_occurrences_overlap_and_repeat(spark):
    """Many literals of one text, inside each other and over each other, against plain search."""
    random.seed(2)
    texts = {i: _text(random.randint(0, 60)) for i in range(60)} | {60: None, 61: ""}
    pairs = [(i, _text(random.randint(0, 4)), random.choice("xyz")) for i in [*texts, 99] for _ in range(20)] + [(3, None, "x")]
    notes = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    given = spark.createDataFrame(pairs, "doc_id long, exact_text string, identifier_type string")
    got = sorted(map(tuple, spans.ground(given, notes, ["doc_id"]).collect()))
    assert got == sorted({(i, s, s + len(x), c) for i, x, c in pairs for s in starts(texts.get(i) or "", x)})
    assert spans.ground(given.limit(0), notes, ["doc_id"]).count() == spans.ground(given, notes.limit(0), ["doc_id"]).count() == 0


def test_a_text_meets_its_literals_once(spark):
    """One join of texts, however many literals; rows are passed on in parts."""
    notes = spark.createDataFrame([(1, "ab" * 50_000)], "doc_id long, text string")
    given = spark.createDataFrame([(1, x, "c") for x in ("a", "b", "ab", "ba", "aba")], "doc_id long, exact_text string, identifier_type string")
    found = spans.ground(given, notes, ["doc_id"])
    assert found.count() == 50_000 * 3 + 49_999 * 2
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize("chars", [1 << 20, 300])
def test_names_of_any_number(spark, monkeypatch, chars):
    """100,000 names in one automaton, and some names in many, against plain search."""
    monkeypatch.setattr(locate, "NAME_CHARS", chars)
    random.seed(3)
    names = [f"Name{i}" for i in range(100_000 if chars > 300 else 60)] + ["Name7", "", "e1", "Ada (x)"]
    texts = [(i, " ".join(f"Name{random.randrange(200_000 if chars > 300 else 90)}" for _ in range(8)) + random.choice(["", " Ada (x)", "e1"])) for i in range(40)] + [(40, None), (41, "")]
    windows = spark.createDataFrame(texts, "doc_id long, text string")
    given = spark.createDataFrame([(n,) for n in names], "name string")
    want = {i: [n for n in sorted(set(names), key=lambda n: (-len(n), n)) if n and n in (t or "")] for i, t in texts}
    got = gazetteer_pairs(windows, given).collect()
    assert sorted((r.doc_id, r.exact_text) for r in got) == sorted((i, n) for i, found in want.items() for n in found)
    out = {r.doc_id: r._names for r in locate.with_names(windows, given, "_names").collect()}
    assert out == want


def test_extractor_takes_names_as_a_table_or_a_list(spark):
    windows = spark.createDataFrame([("a", "Ada Birch and Tom"), ("b", "nobody")], "doc_id string, text string")
    names = ["Ada", "Tom", "Ada Birch"]
    table = spark.createDataFrame([(n,) for n in names], "name string")
    one, other = (PatternExtractor(x).respond(windows).select("doc_id", "content").collect() for x in (names, table))
    assert {r.doc_id: r.content for r in one} == {r.doc_id: r.content for r in other}
    assert next(r.content for r in one if r.doc_id == "a") == '{"identifiers": [{"exact_text": "Ada Birch", "identifier_type": "01_NAME"}, {"exact_text": "Ada", "identifier_type": "01_NAME"}, {"exact_text": "Tom", "identifier_type": "01_NAME"}]}'
