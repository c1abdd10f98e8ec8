import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from maskline.llm import lexical

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, top):
    found = [(i, Counter(t), len(t)) for i, text in docs if (t := _terms(text))]
    n_docs, total, df = len(found), sum(n for *_, n in found), Counter(t for _, c, _ in found for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in found:
            m = 100 - 25 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in _terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def _tables():
    random.seed(6)
    vocab = ["the", "The", "ÀB", "àb", "x1", "1", "ñ", "😀", *(f"w{i}" for i in range(40))]
    text = lambda n: random.choice([" ", "-", "\n", "\x00", "{"]).join(random.choice(vocab) for _ in range(n))
    docs = [(i, text(random.randint(0, 60))) for i in range(150)] + [(3, "the the w1"), (3, "the the w1"), (None, "w1 w2"), (None, None), (900, ""), (901, " -- "), (902, "z" * 200_000 + " w1")]
    docs += [(i, "same text w3 w4") for i in range(200, 260)]
    items = [(i, text(random.randint(0, 12))) for i in range(25)] + [(5, "w1 w1 w2"), (None, "w3"), (26, None), (27, "nowhere"), (28, "same text")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_ranks_against_plain_loops(spark, monkeypatch, small):
    if small:  # many blocks of items and of documents
        for name, value in (("ITEM_TERMS", 60), ("ITEMS", 8), ("IMPACTS", 50), ("PIECE_BYTES", 40)):
            monkeypatch.setattr(lexical, name, value)
    docs, items = _tables()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    assert sorted(map(tuple, lexical.search(d, q, 7).collect()), key=str) == _brute(docs, items, 7)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = d.withColumnRenamed("doc_id", "item_id")
    assert lexical.search(d.limit(0), q).count() == 0
    assert lexical.search(d, q.limit(0)).count() == 0
    assert lexical.search(d, q).count() == 1


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    for bits in (1, 17, 40, 63):
        keys = rng.integers(0, 1 << bits, 5000).astype(np.uint64) // np.uint64(3)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(np.zeros(0, np.uint64))) == 0
