"""Tables with nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns with the operators' own names."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskline.llm import common, line_quality
from maskline.llm.queries import QUERIES

OWN = "row text_ doc_key tie print label component spans kept packed block core context given score piece start length sequence_id offset item rank part step n m at key same".split()


def _hostile(spark):
    random.seed(5)
    line = lambda n: " ".join(random.choice(["alpha", "Beta", "gamma,", "delta"]) for _ in range(n))
    texts = [None, "", " \t\n", "x", line(400), line(400), "w" * 120_000, (line(9) + "\n") * 4000, "same text of a few words here", "same text of a few words here", "\U0001f600\u00e9\x00 z"]
    rows = [(i if i % 5 else None, t, None if i % 2 else "en", "s" if i % 3 else None, len(t or ""), *[i if i % 4 else None] * len(OWN)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (4, "another text of the same id", None, None, None, *[None] * len(OWN))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in OWN))


def _tables(spark, folder, empty):
    docs = _hostile(spark)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("row") % 3 > 0, F.col("lang")).alias("url"), F.col("text").alias("html"), "key", "tie", "core")
    items = docs.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 300).alias("text"), "score", "rank")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (2, 1, 0), (3, 1, 0), (4, 0, 1), (6, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.col("row").alias("turn"), F.when(F.col("row") % 2 == 0, "user").alias("role"), "text", "start")
    for name, df in (("documents", docs), ("pages", pages), ("benchmark", items), ("labels", labels), ("conversations", turns)):
        (df.limit(0) if empty else df).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return docs


@pytest.mark.parametrize("empty", [False, True])
def test_every_query_takes_odd_tables(spark, tmp_path, empty):
    docs = _tables(spark, str(tmp_path), empty)
    n = 0 if empty else docs.count()
    for name, query in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
        rows = query(spark, str(tmp_path)).collect()
        op = name.split("_")[0]
        if op in ("op1", "op2", "op4", "op6", "op7", "op9", "op10", "op12"):
            assert len(rows) == n, name
        elif op == "op8":
            assert empty or len(rows) > 1, name
        else:
            assert not empty or not rows, name


def test_stages_keep_odd_columns(spark, tmp_path):
    docs = _tables(spark, str(tmp_path), False)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        others = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert {tuple(r) for r in out.select(others).collect()} <= {tuple(r) for r in docs.select(others).collect()}, name


def test_short_names_that_meet_are_given_again(spark, monkeypatch):
    """Names of a few bits are shared by chance; the rows then get others, or none would do."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(1, "t1")], "doc_id long, text string")
    seen, look = [], common._shared
    monkeypatch.setattr(common, "_shared", lambda d, names, bits, seed: seen.append(look(d, names, bits, seed)) or seen[-1] or seed < 2)
    keyed = common.keyed_rows(docs, 12)
    assert len(seen) == 3 and keyed.select("doc_key", "tie").distinct().count() == 40
    few = docs.select((F.col("doc_id") % 1).alias("doc_id"), "text")
    monkeypatch.undo()
    assert not common._shared(docs, ["doc_id", "text"], 12, 0)
    monkeypatch.setattr(common, "row_keys", lambda *c, bits, seed: [F.lit(0).alias("doc_key"), F.lit(0).alias("tie")])
    assert common._shared(few, ["doc_id", "text"], 12, 0)


def _classes(c):
    kinds = ("A" <= c <= "Z", "a" <= c <= "z", "0" <= c <= "9", c in " \t\r\x0b\x0c\n", c == "|", c in "#$%&*@^~+=<>_\\/!")
    return next((k for k, yes in enumerate(kinds) if yes), 6)


def _shapes(text):
    """Features of a text's lines by plain loops."""
    seen, out = set(), []
    for line in text.split("\n"):
        raw = line.encode()
        words = line.replace("\t", " ").split(" ")
        words = [w for w in words if w]
        share = [0.0] * 8
        for b in raw:
            share[7 if b >= 128 else _classes(chr(b))] += 1 / max(len(raw), 1)
        n = max(len(words), 1)
        bag = tuple(sorted(words))
        again = bool(words) and bag in seen
        seen.add(bag)
        ends = sum(ord(w.encode().decode("latin-1")[-1]) < 128 and _classes(w[-1]) in (5, 6) for w in words)
        out.append((len(raw), [math.log1p(len(raw)), math.log1p(len(words)), *share, len(raw) / n / 10, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, ends / n, float(again), float(not words)]))
    return out


def test_quality_scores_against_enumerated_labels(spark):
    """Features, neighbours, weights by length and the sum to a document, with all labellings of the lines written out."""
    random.seed(9)
    words = ["Abc", "de,", "f9", "#x", "|", "de,", "g\u00e9"]
    texts = ["", "a", "\n", "x\n\nx"] + ["\n".join(" ".join(random.choice(words) for _ in range(random.randint(0, 5))) for _ in range(random.randint(1, 6))) for _ in range(30)]
    rng = np.random.default_rng(4)
    k = line_quality.SHAPE
    model = line_quality.Model(rng.normal(size=k), rng.uniform(0.5, 2, k), rng.normal(size=3 * k + 1) / 4, rng.normal(size=(2, 2)), 1.3, -0.2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in line_quality.score(docs, model, "doc_id").collect()}
    doc, size, shape = line_quality.line_shapes(pa.array(texts))
    for i, text in enumerate(texts):
        lines = _shapes(text)
        assert size[doc == i].tolist() == [n for n, _ in lines]
        assert np.allclose(shape[doc == i], [f for _, f in lines]), text
        x = [(np.array(f) - model.mean) / model.spread for _, f in lines]
        zero = np.zeros(k)
        bad = [float(np.concatenate([x[j], x[j - 1] if j else zero, x[j + 1] if j + 1 < len(x) else zero, [1.0]]) @ model.weights) for j in range(len(x))]
        weight, share = [], np.zeros(len(x))
        for y in range(1 << len(x)):
            label = [y >> j & 1 for j in range(len(x))]
            w = math.exp(sum(b for b, v in zip(bad, label) if v) + sum(model.moves[p, q] for p, q in zip(label, label[1:])))
            weight.append(w)
            share += w * np.array(label)
        p = share / sum(weight)
        mean = min(max(sum((n + 1) * q for (n, _), q in zip(lines, p)) / sum(n + 1 for n, _ in lines), 1e-4), 1 - 1e-4)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * (math.log(1 - mean) - math.log(mean)) + model.shift))), abs=1e-6)
