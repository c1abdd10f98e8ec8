import random

import numpy as np
import pytest

from maskline.plans import reports

SCHEMA = "model_id string, pass_ string, doc long, gt_phi_chars long, char_tp long"


def _recalls(notes, resamples, seed):
    """By `random.choices` itself."""
    rng, out = random.Random(seed), []
    for _ in range(resamples):
        chosen = rng.choices(range(len(notes)), k=len(notes))
        if whole := sum(notes[i][0] for i in chosen):
            out.append(sum(notes[i][1] for i in chosen) / whole)
    return sorted(out)


@pytest.mark.parametrize("at_once, big", [(1 << 16, 1), (7, 1), (7, 1 << 40)])
def test_the_stream_of_choices(monkeypatch, at_once, big):
    monkeypatch.setattr(reports, "DRAWN_AT_ONCE", at_once)
    rng = random.Random(2)
    notes = [(g * big, rng.randint(0, g) * big) for g in (rng.choice([0, 3, 8]) for _ in range(40))]
    got = reports.choices_recalls(np.array([g for g, _ in notes]), np.array([t for _, t in notes]), 50, 9)
    assert got.tolist() == _recalls(notes, 50, 9)
    assert len(reports.choices_recalls(np.zeros(3, np.int64), np.zeros(3, np.int64), 5, 1)) == 0


def test_groups_are_tasks_that_hold_numbers_only(spark):
    """Groups over several batches, in doc order whatever the order of rows; names and other columns stay outside."""
    rng, rows = random.Random(4), []
    for m, p, n in (("a", "x", 300), ("a", "y", 299), ("b", "x", 1), ("none", "x", 2)):
        rows += [(m, p, d, g, rng.randint(0, g)) for d in range(n) for g in (0 if m == "none" else rng.randint(1, 9),)]
    shuffled = rng.sample(rows, len(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = reports.bootstrap_exact(spark.createDataFrame(shuffled, SCHEMA).repartition(3), 30, 5)
        got = {(r.model_id, r.pass_): r for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert set(got) == {r[:2] for r in rows}
    for key, r in got.items():
        notes = [(g, t) for m, p, _, g, t in rows if (m, p) == key]
        recalls = _recalls(notes, 30, 5)
        assert r.notes == len(notes)
        if recalls:
            assert r.recall == sum(t for _, t in notes) / sum(g for g, _ in notes)
            assert (r.low, r.high) == (pytest.approx(reports._percentile(np.array(recalls), 0.025)), pytest.approx(reports._percentile(np.array(recalls), 0.975)))
        else:
            assert (r.recall, r.low, r.high) == (None, None, None)
    assert reports.bootstrap_exact(spark.createDataFrame([], SCHEMA), 9).count() == 0
