import hashlib
import random

import pytest
from pyspark.sql import functions as F

from maskline.llm import lcpsort, phrase_dedup, repeats, suffix_dedup


def _texts(seed, words):
    random.seed(seed)
    one = (lambda n: " ".join(random.choice(["a", "b", "é", "dd x"]) for _ in range(n))) if words else (lambda n: "".join(random.choice("ab d\né") for _ in range(n)))
    pool = [one(random.randint(5, 120)) for _ in range(8)]
    out = {0: None, 1: "", 2: "   \n"}
    for i in range(3, 60):
        text = random.choice([" ", "\n"]).join(random.choice(pool)[: random.randint(1, 400)] if random.random() < 0.5 else one(random.randint(0, 40)) for _ in range(random.randint(0, 5)))
        out[i] = out[random.choice(list(out))] if random.random() < 0.2 else text
    return out


def _extra(spark, texts):
    """Texts in a table whose other columns have the names that the operators use themselves."""
    names = "doc_key tie packed spans kept n_words removed row block place core context first phrases".split()
    return spark.createDataFrame([(k, v, *range(len(names))) for k, v in texts.items()], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))


@pytest.mark.parametrize("rows", [40_000, 23])
def test_suffixes_against_all_strings(spark, monkeypatch, rows):
    monkeypatch.setattr(lcpsort, "RANGE_ROWS", rows)
    if rows < 100:  # documents of over 120 bytes in parts
        monkeypatch.setattr(repeats, "PART", 120)
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 1)
    texts = _texts(5, False)
    docs = _extra(spark, texts)
    done = suffix_dedup.dedup_bytes(docs, 40, 10).select("row.*", F.struct("n_bytes", "n_removed", "removed", "kept").alias("out")).collect()
    got = {r.doc_id: (r.out.n_bytes, r.out.n_removed, len(r.out.removed), hashlib.sha256(bytes(r.out.kept)).hexdigest()) for r in done}
    assert got == suffix_dedup.brute_force(texts, 40)
    assert {tuple(r[:-1][1:]) for r in done} == {tuple(range(14))}


@pytest.mark.parametrize("block,shard", [(1 << 20, 1 << 20), (3000, 60), (1, 1)])
def test_phrases_against_all_windows(spark, monkeypatch, block, shard):
    """Whatever the size of blocks and automata, the same words go; blocks of one document have only its own passages."""
    monkeypatch.setattr(phrase_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrase_dedup, "SHARD_WORDS", shard)
    texts = _texts(6, True)
    done = phrase_dedup.dedup_phrases(_extra(spark, texts), 9, 3).select("row.*", F.struct("n_words", "n_removed", "kept").alias("out")).collect()
    got = {r.doc_id: (r.out.n_words, r.out.n_removed, hashlib.sha256(r.out.kept.encode()).hexdigest()) for r in done}
    assert got == phrase_dedup.brute_force(texts, 9)
    assert {tuple(r[:-1][1:]) for r in done} == {tuple(range(14))}


def test_automata_locate_what_was_named_elsewhere(spark):
    """The passage of one document is found in the others by the automaton alone."""
    passage, other = [b"p%d" % i for i in range(12)], [b"o%d" % i for i in range(9)]
    texts = [[b"x", *passage, b"y"], [*passage[2:], *passage], other, [b"z"]]
    got = phrase_dedup.occurrences(texts, {tuple(passage): None, tuple(passage[1:]): None}, 9)
    assert got == [[(1, 13)], [(10, 22)], [], []]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    text = "w " * 500
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], schema)
    got = sorted((r.row.doc_id or -1, r.n_words, r.n_removed) for r in phrase_dedup.dedup_phrases(docs).collect())
    assert got == [(-1, 500, 500), (1, 500, 500), (1, 500, 500), (2, 0, 0)]
    got = sorted((r.row.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_bytes(docs).collect())
    assert got == [(-1, 1000, 1000), (1, 1000, 1000), (1, 1000, 1000), (2, 0, 0)]
    empty = spark.createDataFrame([], schema)
    assert phrase_dedup.dedup_phrases(empty).count() == 0
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_loser_tree_keeps_order_and_prefixes():
    random.seed(2)
    rows = sorted((bytes(random.choice(b"ab") for _ in range(random.randint(0, 9))), (i, 0, 0, 0)) for i in range(200))
    runs = [rows[i::7] for i in range(7)]

    def feed(run):
        it, last = iter(run), [b""]

        def following():
            for s, n in it:
                shared = lcpsort.common_prefix(last[0], s)
                last[0] = s
                return s, n, shared
            return None

        return following

    got = list(lcpsort.LoserTree([feed(r) for r in runs]))
    assert [g[0] for g in got] == [r[0] for r in rows]
    assert [g[2] for g in got[1:]] == [lcpsort.common_prefix(a[0], b[0]) for a, b in zip(rows, rows[1:])]
