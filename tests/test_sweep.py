import random

from maskline.operators import score
from maskline.functions.constants import TOLERANCE

CODES = ["01_NAME", "01_OTHER", "03_DATE", "UNKNOWN", ""]
KEYS = ["model_id", "pass", "doc_id"]


def _frames(spark, universe, docs, gold, predicted):
    return (
        spark.createDataFrame(universe, "model_id string, pass string, doc_id long"),
        spark.createDataFrame(docs, "doc_id long, n_chars int"),
        spark.createDataFrame(gold, "doc_id long, span_no int, start int, end int, code string"),
        spark.createDataFrame(predicted, "model_id string, pass string, doc_id long, start int, end int, identifier_type string"),
    )


def _tables():
    """Spans of all kinds: empty, repeated, nested, over the end, of notes without gold, and of runs that were not asked for."""
    random.seed(8)
    docs = [(d, random.choice([0, 3, 40, 90])) for d in range(12)]
    span = lambda n: (lambda a: (a, a + random.choice([0, 1, 3, 8, 20])))(random.randint(0, max(n, 1)))
    gold = [(d, i, *span(n), random.choice(CODES)) for d, n in docs for i in range(random.choice([0, 2, 9]))]
    runs = [("a", "x"), ("a", "y"), ("b", "x")]
    universe = [(m, p, d) for m, p in runs for d, _ in [*docs, (99, 0)] if random.random() < 0.9]
    predicted = [(m, p, d, *span(n), random.choice(CODES)) for m, p in [*runs, ("c", "x")] for d, n in [*docs, (99, 50)] for _ in range(random.choice([0, 1, 7]))]
    return universe, docs, gold, predicted + predicted[:5]


def _two(code):
    return code[:2] if code[:2].isdigit() else code


def _covered(spans):
    return {x for a, b in spans for x in range(a, b)}


def test_sweeps_against_sets_of_characters(spark):
    universe, docs, gold, predicted = _tables()
    frames, size = _frames(spark, universe, docs, gold, predicted), dict(docs)
    asked = [(m, p, d) for m, p, d in universe if d in size]
    own = {d: [(i, a, b, c) for x, i, a, b, c in gold if x == d] for d in size}
    said = {k: [(a, b, c) for m, p, d, a, b, c in predicted if (m, p, d) == k] for k in asked}
    cut = {k: [(a, min(b, size[k[2]]), c) for a, b, c in v] for k, v in said.items()}

    chars = {}
    for k in asked:
        g, p = _covered((a, b) for _, a, b, _ in own[k[2]]), _covered((a, b) for a, b, _ in cut[k])
        tp, n = len(g & p), size[k[2]]
        chars[k] = (n, len(g), len(p), tp, len(p) - tp, len(g) - tp, n - len(g | p), len(g) - tp)
    got = score.char_counts(*frames).select(*KEYS, "doc_chars", "gt", "pred_chars", "tp", "fp", "fn", "tn", "residual").collect()
    assert sorted((tuple(r)[:3], tuple(r)[3:]) for r in got) == sorted(chars.items())

    near = lambda s, bounds, t: int(any(abs(s[0] - a) <= t and abs(s[1] - b) <= t for a, b in bounds))
    hits = {}
    for k in asked:
        cover, bounds = _covered((a, b) for a, b, _ in cut[k]), {(a, b) for a, b, _ in said[k]}
        for i, a, b, c in own[k[2]]:
            n = len(cover & set(range(a, b)))
            hits[(*k, i)] = (c, a, b, int(n > 0), int(n == b - a), near((a, b), bounds, 0), near((a, b), bounds, TOLERANCE))
    got = score.span_hits(*frames).select(*KEYS, "span_no", "code", "start", "end", "any", "full", "strict", "relaxed").collect()
    assert sorted((tuple(r)[:4], tuple(r)[4:]) for r in got) == sorted(hits.items())

    types = {}
    for k in asked:
        for code in {c for *_, c in own[k[2]]}:
            g = _covered((a, b) for _, a, b, c in own[k[2]] if c == code)
            p, m = _covered((a, b) for a, b, _ in cut[k]), _covered((a, b) for a, b, c in cut[k] if _two(c) == _two(code))
            mine = [hits[(*k, i)] for i, *_, c in own[k[2]] if c == code]
            types[(*k, code)] = (len(g), len(g & p), len(g & m), len(m), len(g) - len(g & p), len(mine), *(sum(h[j] for h in mine) for j in range(3, 7)))
    got = score.type_scores(*frames).collect()
    assert sorted((tuple(r)[:4], tuple(r)[4:]) for r in got) == sorted(types.items())

    every = {(m, p, d) for m, p, d, *_ in predicted}
    counts = {}
    for m, p, d in every:
        bounds = {(a, b) for x, y, z, a, b, _ in predicted if (x, y, z) == (m, p, d)}
        counts[m, p, d] = (len(bounds), sum(near(b, {(a, e) for x, _, a, e, _ in gold if x == d}, TOLERANCE) for b in bounds))
    got = score.predicted_spans(frames[2], frames[3]).collect()
    assert sorted((tuple(r)[:3], tuple(r)[3:]) for r in got) == sorted(counts.items())


def test_empty_sides(spark):
    universe, docs, gold, predicted = _frames(spark, *_tables())
    for name in ("char_counts", "span_hits", "type_scores"):
        assert getattr(score, name)(universe.limit(0), docs, gold, predicted).count() == 0
    assert score.char_counts(universe, docs, gold.limit(0), predicted.limit(0)).where("gt + pred_chars + tp > 0 or tn <> doc_chars").count() == 0
    assert score.span_hits(universe, docs, gold, predicted.limit(0)).where("any + strict + relaxed > 0").count() == 0
    assert score.predicted_spans(gold.limit(0), predicted).where("relaxed_pred > 0").count() == 0


def test_a_note_with_many_spans_takes_one_shuffle(spark):
    """10^5 spans on both sides of one note: all meet, in time that grows with their number, after one exchange."""
    n = 100_000
    rows = spark.range(n)
    gold = rows.selectExpr("1L as doc_id", "cast(id as int) as span_no", "cast(id * 4 as int) as start", "cast(id * 4 + 3 as int) as end", "'01_NAME' as code")
    predicted = rows.selectExpr("'m' as model_id", "'x' as pass", "1L as doc_id", "cast(id * 4 + 1 as int) as start", "cast(id * 4 + 4 as int) as end", "'01_NAME' as identifier_type")
    frames = spark.createDataFrame([("m", "x", 1)], "model_id string, pass string, doc_id long"), spark.createDataFrame([(1, 4 * n)], "doc_id long, n_chars int"), gold, predicted
    counts = score.char_counts(*frames)
    assert tuple(counts.select("gt", "pred_chars", "tp").head()) == (3 * n, 3 * n, 2 * n)
    hits = score.span_hits(*frames).agg({"any": "sum", "full": "sum", "strict": "sum", "relaxed": "sum"}).head()
    assert (hits["sum(any)"], hits["sum(full)"], hits["sum(strict)"], hits["sum(relaxed)"]) == (n, 0, 0, n)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    # one deals the spans to their notes; the other only drops repeated rows of the universe
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange ") <= 2
