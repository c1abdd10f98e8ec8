import math
import random

import numpy as np
import pyarrow as pa
import pytest

from maskline.llm import line_quality, toxicity


def test_toxicity_learns_words(spark):
    random.seed(1)
    plain = lambda: " ".join(random.choice(["river", "stone", "cloud", "paper", "table", "green"]) for _ in range(random.randint(3, 40)))
    docs, labels = [(998, None, 1.0), (999, "", 1.0)], [(None, 1), (998, None)]
    for i in range(300):
        bad = i % 4 == 0
        docs.append((i, plain() + (" You grumblewort " if bad else " ") + plain(), 0.5))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y)
    got = {r.doc_id: r.score for r in toxicity.score(d.drop("score"), model, "doc_id").collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in range(300)]) > 0.97
    assert 0 <= got[998] == got[999] <= 1
    assert toxicity.train(d, y.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(d, None, "doc_id").collect()} == {0.0}
    assert toxicity.score(d.drop("score").limit(0), model, "doc_id").count() == 0


def _buckets(text):
    """Buckets of all n-grams of a text, by plain loops."""
    out, chars = set(), [ord(c) for c in text.lower()]
    for i in range(len(chars)):
        state = 0
        for k in range(1, min(6, len(chars) - i) + 1):
            state = (state + chars[i + k - 1] + k) * 0x9E3779B1 & 0xFFFFFFFF
            state ^= state >> 15
            if k >= 4:
                out.add((state * 0x85EBCA6B & 0xFFFFFFFF) >> 12)
    return out


def test_toxicity_counts_ratios_and_scores_against_plain_loops(spark):
    random.seed(5)
    texts = ["", "Abc", "ÀÉ😀 long"] + ["".join(random.choice("aBcé d\n") for _ in range(random.randint(0, 60))) for _ in range(40)]
    y = [i % 3 == 0 for i in range(len(texts))]
    found = [_buckets(t) for t in texts]
    counts = {(r.bucket): (r.other, r.toxic) for r in spark.createDataFrame([(int(v), t) for v, t in zip(y, texts)], "y int, text string").mapInArrow(toxicity._lists, "y int, buckets binary").mapInArrow(toxicity._counts, "bucket int, other int, toxic int").groupBy("bucket").sum("other", "toxic").toDF("bucket", "other", "toxic").collect()}
    assert counts == {b: (sum(b in f and not v for f, v in zip(found, y)), sum(b in f and v for f, v in zip(found, y))) for f in found for b in f}
    for a, b in ((0, 9), (9, 0), (1, 0), (3, 1)):
        p, q = a + 4 * 30 / 40, b + 4 * 10 / 40
        r = math.log((q / 10) / (p / 30))
        z = r / math.sqrt(1 / p + 1 / q)
        assert toxicity.log_ratios(np.array([a]), np.array([b]), 30, 10)[0] == pytest.approx(r * z * z / (z * z + 16))
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, "doc_id").collect()}
    for i, f in enumerate(found):
        margin = sum(float(model.weights[b]) for b in f) - 0.5
        assert got[i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    doc = np.array([0, 0, 0, 1, 2, 2])
    bad, moves = rng.normal(size=6), rng.normal(size=(2, 2))
    got, pairs = line_quality.Chains(doc).marginals(bad, moves)
    want, total = np.zeros(6), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weights = {}
        for k in range(1 << len(at)):
            y = [k >> i & 1 for i in range(len(at))]
            weights[k] = np.exp(sum(bad[i] for i, v in zip(at, y) if v) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        for k, w in weights.items():
            y = [k >> i & 1 for i in range(len(at))]
            for i, v in zip(at, y):
                want[i] += v * w / z
            for a, b in zip(y, y[1:]):
                total[a, b] += w / z
    assert np.allclose(got, want) and np.allclose(pairs, total)


def test_quality_learns_lines(spark):
    random.seed(3)
    good = lambda: " ".join(random.choice(["river", "stone", "cloud", "paper"]) for _ in range(random.randint(4, 20))).capitalize() + "."
    junk = lambda: random.choice(["BUY NOW!! ", "a | b | c ", "zz### yy%%% "]) * random.randint(3, 9)
    docs = [(998, None), (999, "")]
    for i in range(200):
        lines = [good() for _ in range(random.randint(1, 6))] if i % 3 else [good(), *(junk() for _ in range(random.randint(3, 6)))]
        docs.append((i, "\n".join(lines)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(200)], "doc_id long, quality int")
    model = line_quality.train(d, y)
    got = {r.doc_id: r.score for r in line_quality.score(d, model, "doc_id").collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 3) for i in range(200)]) > 0.97
    assert 0 <= got[998] == got[999] <= 1
    assert line_quality.train(d, y.where("quality = 1")) == 1.0
    doc, size, shape = line_quality.line_shapes(pa.array(["a\n\nb", "", "x"]))
    assert doc.tolist() == [0, 0, 0, 1, 2] and size.tolist() == [1, 0, 1, 0, 1] and shape.shape == (5, line_quality.SHAPE)


def test_mini_batches_fit_what_plain_loops_fit():
    """A part's weights against the same steps with sets; every document's buckets are stored once."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc d"), 30)) for _ in range(150)]
    y = (rng.random(150) < 0.3).astype(int)
    (stored,) = toxicity._lists([pa.RecordBatch.from_pydict({"y": y, "text": texts})])
    lists = toxicity._stored(stored)
    assert [set(x.tolist()) for x in lists] == [_buckets(t) for t in texts]
    given = type("Given", (), {})
    ratio, start = given(), given()
    ratio.value, start.value = rng.normal(size=1 << toxicity.BITS), np.zeros((1 << toxicity.BITS) + 1)
    (got,) = toxicity._fit_part(ratio, start)([stored.slice(0, 40), stored.slice(40)])
    w, adam, order = np.zeros((1 << toxicity.BITS) + 1), toxicity.Adam((1 << toxicity.BITS) + 1, 0.05), np.random.default_rng(5).permutation(150)
    for _ in range(toxicity.EPOCHS):
        for own in np.array_split(order, 3):
            g = 1e-3 * w
            g[-1] = 0
            for i in own:
                d = (1 / (1 + math.exp(-(sum(ratio.value[b] * w[b] for b in lists[i]) + w[-1]))) - y[i]) / len(own)
                for b in lists[i]:
                    g[b] += d * ratio.value[b]
                g[-1] += d
            w = adam.step(w, g)
    at = got["bucket"].to_numpy()
    assert set(at[:-1].tolist()) == set(np.concatenate(lists).tolist()) and at[-1] == 1 << toxicity.BITS
    assert got["weight"].to_numpy() == pytest.approx(w[at], abs=1e-6)
