import random

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from maskline.llm import similar
from maskline.llm.decontaminate import text_shingles

WORDS = [f"w{i}" for i in range(3000)]


def _jaccard(a, b):
    p, q = text_shingles(a), text_shingles(b)
    return len(p & q) / len(p | q)


def _texts():
    """Texts with copies of similarity 0.7 to 0.97, chains of copies, and short, empty and equal texts."""
    random.seed(12)
    out = {0: None, 1: "", 2: " \t", 3: "one two", 4: "ONE  two", 5: "one two three"}
    bases = [[random.choice(WORDS) for _ in range(random.randint(10, 400))] for _ in range(40)]
    out |= {i: " ".join(b) for i, b in enumerate(bases, 10)}
    for i in range(100, 260):
        words = random.choice([*bases, out[random.randint(10, 49)].split()]) if i < 200 else out[random.choice([k for k in out if k >= 10])].split()
        words = list(words)
        for _ in range(max(1, round(len(words) * random.uniform(0.002, 0.04)))):
            words[random.randrange(len(words))] = random.choice(WORDS)
        out[i] = " ".join(words)
    return out


def test_stage_against_all_pairs(spark, tmp_path):
    texts = _texts()
    shares = [_jaccard(texts[i], texts[j]) for i in texts for j in texts if 10 <= i < j]
    assert min(sum(a <= s < a + 0.05 for s in shares) for a in (0.75, 0.8, 0.85, 0.9)) >= 10
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == set(similar.brute_force(texts).values())
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_of_a_key_are_paired_over_batches():
    random.seed(14)
    keys = sorted(random.choices(range(40), k=300))
    rows = [(k, i, 5) for i, k in enumerate(keys)]
    for sizes in ((300,), (1,) * 300, (7, 100, 3, 190), (299, 1)):
        at, batches = 0, []
        for size in sizes:
            batches.append(pa.RecordBatch.from_pydict({c: [r[j] for r in rows[at : at + size]] for j, c in enumerate(("key", "row", "n"))}))
            at += size
        got = [r for b in similar._neighbours(batches) for r in b.to_pylist()]
        assert len({r["row"] for r in got}) == len(got)
        edge = {keys[0], keys[-1]}
        assert {r["row"] for r in got} == {i for i, k in enumerate(keys) if keys.count(k) > 1 or k in edge}
        for r in got:
            place = r["row"] - keys.index(r["key"])
            assert r["before"] == (None if place == 0 else keys.index(r["key"]) + (place - 1) // 2)
            assert r["n_before"] == (None if place == 0 else 5)


def test_candidates_at_the_threshold(spark):
    """Of pairs of similarity 0.8 to 0.82 all share a key."""
    random.seed(13)
    rows = []
    while len(rows) < 600:
        words = [random.choice(WORDS) for _ in range(random.randint(60, 500))]
        other = list(words)
        for _ in range(round(len(words) * 0.022)):
            other[random.randrange(len(other))] = random.choice(WORDS)
        if 0.8 <= _jaccard(" ".join(words), " ".join(other)) < 0.82:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    keys = {r.k: set(r["keys"]) for r in similar.sketches(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    assert all(keys[i] & keys[i + 1] for i in range(0, len(rows), 2))


def test_prefixes_lose_no_pair_and_make_few(spark):
    """All pairs of similarity 0.8 or more meet; texts of a template at 0.6 to 0.8 do not all meet."""
    random.seed(15)
    texts = _texts()
    template = [random.choice(WORDS) for _ in range(150)]
    family = range(1000, 1080)
    for i in family:
        words = list(template)
        words[(i * 7) % 100 : (i * 7) % 100 + 22] = [f"own{i}x{k}" for k in range(22)]
        texts[i] = " ".join(words)
    shares = [_jaccard(texts[i], texts[j]) for i in family for j in family if i < j]
    assert sum(0.6 < s < 0.8 for s in shares) > 500
    pressed = zstandard.ZstdCompressor()
    full = {k: t for k, t in texts.items() if (t or "").split()}
    rows = spark.createDataFrame([(k, k, pressed.compress(t.encode())) for k, t in full.items()], "row long, label long, packed binary").repartition(3)
    got = {tuple(r) for r in similar.prefix_pairs(rows).collect()}
    want = {(i, j) for i in full for j in full if i < j and _jaccard(full[i], full[j]) >= 0.8}
    assert want <= got
    assert sum(i in family and j in family for i, j in got) < len(shares) / 10
    same = rows.withColumn("label", F.lit(1).cast("long"))
    assert similar.prefix_pairs(same).count() == 0
