import hashlib
import math
import random

import numpy as np
import pytest

from maskline.plans import reports

PRIME = 2**31 - 1


def _weight(seed, b, doc):
    """By plain numbers: a cubic polynomial of the note's number, through the inverse of Poisson(1)."""
    h, x = hashlib.md5(f"{seed}-{b}".encode()).hexdigest(), int(hashlib.md5(str(doc).encode()).hexdigest()[:8], 16) % PRIME
    c = [int(h[8 * i : 8 * i + 8], 16) % PRIME for i in range(4)]
    u = (c[0] * x**3 + c[1] * x**2 + c[2] * x + c[3]) % PRIME
    return sum(u >= int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))


def _percentile(values, q):
    k = (len(values) - 1) * q
    low, values = int(k), sorted(values)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (k - low)


def _rows(n):
    random.seed(3)
    rows = [(m, p, f"d{d}", random.choice([0, 5, 9]), 0) for m in "ab" for p in "xy" for d in range(n if m == "a" else n - 6)]
    return [(m, p, d, g, random.randint(0, g)) for m, p, d, g, _ in rows] + [("none", "x", "d1", 0, 0)]


SCHEMA = "model_id string, pass_ string, doc string, gt_phi_chars long, char_tp long"


def test_intervals_against_plain_loops(spark):
    rows = _rows(30)
    got = {(r.model_id, r.pass_): r for r in reports.bootstrap(spark.createDataFrame(rows, SCHEMA).repartition(5), 60, 7).collect()}
    assert set(got) == {r[:2] for r in rows}
    for key, r in got.items():
        notes = [(d, g, t) for m, p, d, g, t in rows if (m, p) == key]
        drawn = [[(_weight(7, b, d), g, t) for d, g, t in notes] for b in range(60)]
        recalls = [sum(w * t for w, _, t in s) / sum(w * g for w, g, _ in s) for s in drawn if sum(w * g for w, g, _ in s)]
        assert r.notes == len(notes)
        if key[0] == "none":
            assert (r.recall, r.low, r.high) == (None, None, None)
        else:
            assert r.recall == sum(t for *_, t in notes) / sum(g for _, g, _ in notes)
            assert r.low == pytest.approx(_percentile(recalls, 0.025)) and r.high == pytest.approx(_percentile(recalls, 0.975))
    assert reports.bootstrap(spark.createDataFrame([], SCHEMA), 9).count() == 0


def test_weights_are_poisson_and_apart():
    """Means and variances of 1, and no covariance between notes or between resamples."""
    w = reports.weights(reports.note_numbers([f"n{i}" for i in range(400)]), reports.draw_numbers(1, 2000)).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w[:40]) - np.eye(40)).max() < 0.12
    assert np.abs(np.corrcoef(w[:, :40].T) - np.eye(40)).max() < 0.25


def test_what_moves_does_not_grow_with_notes(spark):
    """Sums leave a task once for each group and resample, whatever it has read."""

    def moved(n):
        df = spark.createDataFrame(_rows(n), SCHEMA).coalesce(1)
        return df.where("gt_phi_chars > 0").mapInPandas(reports._resampled(50, 7), "model_id string, pass_ string, b int, gt long, tp long").count()

    assert moved(40) == moved(700) == 4 * 50


def test_intervals_are_those_of_resampling(spark):
    """Close to the percentiles of ordinary resampling with replacement."""
    random.seed(11)
    rows = [("a", "x", str(d), g, random.randint(g // 2, g)) for d in range(300) for g in (random.randint(1, 40),)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, other = reports.bootstrap(df, 3000, 5).head(), reports.bootstrap_exact(df, 3000, 5).head()
    width = other.high - other.low
    assert abs(one.low - other.low) < width / 8 and abs(one.high - other.high) < width / 8
