import random
import re
from itertools import permutations

import pytest

from maskline.llm import filter_audit


def _fails(rows):
    """Sets of failed filters by plain loops."""
    ids = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            ids.setdefault(text or "", set()).add(doc_id)
    for doc_id, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(x < doc_id for x in ids[t])
        yield {f for f, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), copy)) if bad}


def _brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    docs = [(i, s or "", f) for (i, _, s), f in zip(rows, _fails(rows))]
    out = set()
    for part in {s for _, s, _ in docs}:
        own = [(i, f) for i, s, f in docs if s == part]
        removed = {(o, k): [i for i, f in own if o[k] in f and not f & set(o[:k])] for o in permutations("ABCDE") for k in range(5)}
        total = {c: sum(len(x) for (o, k), x in removed.items() if o[k] == c) for c in "ABCDE"}
        for (o, k), gone in removed.items():
            failing = sum(o[k] in f for _, f in own)
            kept = sum(not f & set(o[: k + 1]) for _, f in own)
            out.add((part, "".join(o), k + 1, kept, len(gone), failing - len(gone), sum(f == {o[k]} for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone), total[o[k]]))
    return out


def test_audit_against_every_order(spark):
    random.seed(2)
    texts = [None, "", " \t\n", "x " * 700, "Ab\u00a0CD " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}|" for i in range(60)), "\U0001f600" * 50, "w" * 300_000, " ".join(f"W{i}" for i in range(49))]
    rows = [(random.choice([None, *range(30)]), random.choice(texts), random.choice([None, "", "s", "s", "s", "t"])) for _ in range(150)]
    rows += [(7, "twice", "s"), (7, "twice", "s"), (9, "twice", "t")]
    labels = [(random.choice([None, *range(30)]), random.choice([None, 0, 1]), random.choice([None, 0, 1])) for _ in range(60)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, part int, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    assert len(got) == 3 * 120 * 5 and {tuple(r) for r in got} == _brute(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}


@pytest.mark.parametrize("counts", [{}, {0: 5}, {31: 7, 1: 2, 6: 9}])
def test_polynomial(counts):
    removal = filter_audit.Removal(counts)
    for on in range(32):
        assert removal.corner(on) == sum(n for fails, n in counts.items() if fails & on)
    assert sum(removal.shapley(i) for i in range(5)) == removal.corner(31)
