import random
import zlib
from collections import Counter

import pandas as pd

import corpus_pipeline
from maskline.llm import decontaminate, packing, similar, toxicity
from maskline.llm.queries import QUERIES, SQL

from .test_classifiers import _buckets


def test_stages_keep_columns_and_remove_what_they_should(spark, tmp_path):
    passage = " ".join(f"shared{i}" for i in range(60))
    item = " ".join(f"item{i}" for i in range(40))
    own = lambda k, n=80: " ".join(f"d{k}w{i}" for i in range(n))
    rows = [(i, own(i)) for i in range(6)] + [(10, own(0)), (11, own(20) + " " + passage), (12, own(21) + " " + passage), (13, own(22) + " " + item), (14, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes[name] = {r.doc_id: r for r in docs.collect()}
    assert set(sizes["toxicity"]) == {i for i, _ in rows}
    assert set(sizes["near_dedup"]) == {i for i, _ in rows} - {10}
    assert "shared3" not in sizes["substring_dedup"][11].text and sizes["substring_dedup"][3].text == own(3)
    assert set(sizes["decontamination"]) == set(sizes["near_dedup"]) - {13}
    assert set(sizes["packing"]) == set(sizes["decontamination"])


def _without_passages(texts, width=35):
    """Texts without the words of windows that start twice; others stay as they are."""
    split = {k: t.encode().split() for k, t in texts.items()}
    seen = Counter(tuple(w[i : i + width]) for w in split.values() for i in range(len(w) - width + 1))
    out = {}
    for k, w in split.items():
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out[k] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else texts[k]
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on tables with toxic texts, near copies, shared passages and benchmark items, and columns with the operators' own names."""
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    passage, item = line(60), line(25)
    texts = {i: line(random.randint(5, 300)) for i in range(60)} | {200: "", 201: "one", 202: "ONE"}
    for i in range(60, 90):
        words = texts[random.randrange(40)].split()
        words[random.randrange(len(words))] = "other"
        texts[i] = " ".join(words)
    texts |= {i: f"{line(50)} {passage} {line(9)}" for i in range(90, 96)} | {i: f"{line(200)}\n{item.upper()} {line(200)}" for i in range(96, 99)}
    texts |= {i: f"{line(20)} you vile grumblewort {line(20)}" for i in range(100, 140)} | {i: line(43) for i in range(140, 200)}
    names = "doc_key score row kept spans given label tie print component".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), *range(len(names))) for k, t in texts.items()], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 140)) for i in range(100, 200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {k: t for k, t in texts.items() if float(sum(model.weights[b] for b in _buckets(t))) + model.bias < 0}
    assert 30 < len(texts) - len(left) <= 45
    groups = similar.brute_force(left)
    left = {k: t for k, t in left.items() if groups[k] == k}
    left = _without_passages(left)
    leaks = {d for d, _, _ in decontaminate.brute_force(pd.DataFrame(left.items(), columns=["doc_id", "text"]), pd.DataFrame([(1, item)], columns=["item_id", "text"]))}
    assert len(leaks) == 3
    want = set()
    for k, t in left.items():
        if k not in leaks:
            ids = packing.token_ids(t, packing.default_vocabulary())
            want |= {(k, n, start, size, zlib.crc32(ids[start : start + size].tobytes())) for n, (start, size) in enumerate(packing.pieces(len(ids)))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.select(names).distinct().collect() == [tuple(range(len(names)))], name


def test_registry():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(SQL) <= set(QUERIES)
