import random
import re

import numpy as np
import pandas as pd
import xxhash

from maskline.llm import decontaminate, fingerprint, simhash_near

WORDS = [f"w{i}" for i in range(70)]


def _near_texts(n=120):
    random.seed(3)
    out = {0: None, 1: "", 2: "one", 3: "ONE", 4: " \t"}
    for i in range(5, n):
        t = [random.choice(WORDS) for _ in range(random.randint(0, 120))]
        if random.random() < 0.6:
            t = (out[random.choice(list(out))] or "").split(" ")
            for _ in range(random.randint(0, 2)):
                t[random.randrange(len(t))] = random.choice(WORDS).upper()
        out[i] = " ".join(t)
    return out


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    texts = _near_texts()
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, print int")
    got = {r.doc_id: (f"{r.print % 2**64:016x}", r.component_id) for r in simhash_near.near_duplicates(docs).collect()}
    assert got == simhash_near.brute_force(texts)
    kept = {r.doc_id for r in simhash_near.one_of_each(docs).collect()}
    assert kept == {c for _, c in got.values()}
    assert simhash_near.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_dense_prints_join_what_all_pairs_join(monkeypatch):
    monkeypatch.setattr(simhash_near, "BLOCK", 8)
    random.seed(4)
    base = random.getrandbits(64)
    prints = np.array(sorted({base ^ sum({1 << random.randrange(0, 64, 3) for _ in range(random.randint(0, 5))}) for _ in range(300)}), np.uint64)
    roots = []
    links = simhash_near.spanning_links(np.zeros(len(prints), np.int64), prints, 4)
    assert len(links) < 2 * len(prints)
    for pairs in (links, [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4]):
        sets = simhash_near._Sets(len(prints))
        for a, b in pairs:
            sets.join(a, b)
        roots.append([sets.root(i) for i in range(len(prints))])
    assert roots[0] == roots[1]


def test_longer_chains_find_the_same_pairs():
    random.seed(5)
    for chain in (2, 3):
        masks = simhash_near.ring_masks(4, chain)
        for _ in range(300):
            x = sum({1 << random.randrange(64) for _ in range(4)})
            assert any(x & m == 0 for m in masks)
            assert simhash_near.chained(np.array([x], np.uint64), 4)[0]


def test_block_tables_find_all_within_radius(spark):
    random.seed(6)
    base = [(random.getrandbits(64), random.getrandbits(64)) for _ in range(5)]
    prints = []
    for h, low in base * 20:
        for _ in range(random.randint(0, 6)):
            b = random.randrange(128)
            h, low = (h ^ (1 << b), low) if b < 64 else (h, low ^ (1 << (b - 64)))
        prints.append((h, low))
    prints = sorted(set(prints))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([([signed(a), signed(b)],) for a, b in prints], "print array<long>")
    got = {(tuple(r.query), tuple(r.print)): r.apart for r in fingerprint.within_radius(df, df).collect()}
    want = {}
    for a in prints:
        for b in prints:
            n = (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count()
            if n <= 4:
                want[(tuple(map(signed, a)), tuple(map(signed, b)))] = n
    assert got == want


def test_next_documents_and_fingerprints(spark):
    rows = [(9, "a b c d e f g h i"), (7, None), (7, "x y z"), (3, "😀é" * 20), (None, "last one"), (1, "")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, place int")
    got = {(r.doc_id, r.text): r.next_text for r in fingerprint.with_next(docs).where("extra = 0").collect()}
    assert got == {(9, rows[0][1]): "", (7, ""): "x y z", (7, "x y z"): rows[3][1], (3, rows[3][1]): "", (1, ""): "last one", (None, "last one"): rows[0][1]}
    prints = {r.t: list(r.print) for r in fingerprint.fingerprints(spark.createDataFrame([("a b",), ("",), ("a b c d",)], "t string"), "t", "t").collect()}
    assert prints[""] == [0, 0] and prints["a b"] != prints["a b c d"]


def test_fingerprint_bits_against_plain_votes(spark):
    random.seed(9)
    texts = ["", " \t\n", "one", "one two", "é😀 ü \x0b x"] + [" ".join(random.choice([*WORDS, "a" * 40, "é" * 20]) for _ in range(random.choice([3, 30, 1500]))) for _ in range(25)]
    rows = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "n long, t string"), "t", "n").collect()
    for r in rows:
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", texts[r.n]) if w]
        votes, whole = [0] * 128, 0
        for a, b in zip(words, [*words[1:], None]):
            h0 = xxhash.xxh64_intdigest(a.encode(), 42)
            if b is not None:
                h0 = xxhash.xxh64_intdigest(b.encode(), h0)
            h1 = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(h0.to_bytes(8, "little"), 42))
            weight = min(31, len(a) + len(b or ""))
            whole += weight
            for k in range(128):
                votes[k] += weight * ((h0 if k < 64 else h1) >> k % 64 & 1)
        want = [sum(1 << i for i in range(64) if votes[64 * k + i] * 2 > whole) for k in (0, 1)]
        assert [x % (1 << 64) for x in r.print] == want


def test_hot_keys_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash_near, "HOT", 10)
    random.seed(10)
    centers = [random.getrandbits(64) for _ in range(3)]
    prints = sorted({c ^ sum({1 << random.randrange(64) for _ in range(random.randint(0, 5))}) for c in centers for _ in range(60)})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash_near.links(df).collect()]
    sets, plain = simhash_near._Sets(len(prints)), simhash_near._Sets(len(prints))
    number = {p: i for i, p in enumerate(prints)}
    for a, b in edges:
        sets.join(number[a], number[b])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                plain.join(i, j)
    assert [sets.root(i) for i in range(len(prints))] == [plain.root(i) for i in range(len(prints))]


def test_trees_have_no_hubs():
    random.seed(11)
    pairs = np.array([(0, i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(50)])
    edges = simhash_near.tree_edges(pairs, 400)
    assert len(edges) == 199 + 50 and np.bincount(edges.ravel()).max() <= 3
    a, b = simhash_near._Sets(400), simhash_near._Sets(400)
    for x, y in pairs.tolist():
        a.join(x, y)
    for x, y in edges.tolist():
        b.join(x, y)
    assert [a.root(i) for i in range(400)] == [b.root(i) for i in range(400)]


def test_votes_of_long_texts_fit(spark):
    """A repeated term gives one of its bits all votes of every chunk; the fingerprint is that term's hashes."""
    word = "x" * 20
    texts = [(n, " ".join([word] * n)) for n in (3, 1023, 1024, 1025, 5000)]
    rows = fingerprint.fingerprints(spark.createDataFrame(texts, "n long, t string"), "t", "n").collect()
    first = spark.range(1).selectExpr(f"xxhash64('{word}', '{word}') AS h").head().h
    assert len(rows) == len(texts) and {r.print[0] for r in rows} == {first}


def test_containment_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHINGLE_BITS", 1)  # a bitmap with many false hits
    random.seed(8)
    line = lambda n: " ".join(random.choice(WORDS) + str(random.randrange(9)) for _ in range(n))
    items = [(i, line(random.randint(1, 90))) for i in range(25)] + [(90, None), (91, ""), (92, "tiny item"), (93, "tiny item")] + [(100 + i, line(5 + i % 5)) for i in range(40)]
    docs = [(0, None), (1, ""), (2, "Tiny  ITEM")]
    for i in range(3, 60):
        parts = [line(random.randint(0, 300))]
        if random.random() < 0.7:
            w = (random.choice(items)[1] or "").split()
            parts.insert(random.randint(0, 1), " \n".join(w[: len(w) - random.randint(0, 3)]).upper())
        docs.append((i, " ".join(parts)))
    for i in range(60, 100):  # short items deep inside long documents
        docs.append((i, line(random.randint(900, 1500)) + " " + items[29 + i - 60][1] + " " + line(700)))
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, `whole text` int, item_id int, row int")
    it = spark.createDataFrame([(*x, 4) for x in items], "item_id long, text string, key int")
    got = {(r.row.doc_id, r.item.item_id, r.containment) for r in decontaminate.contained(d, it).collect()}
    want = decontaminate.brute_force(pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"]))
    assert got == want and len(want) > 50
    clean = decontaminate.without_leaks(d, it)
    assert clean.columns == d.columns
    assert {tuple(r) for r in clean.collect()} == {(i, t, 1, 2, 3) for i, t in docs if i not in {w[0] for w in want}}
    assert decontaminate.contained(d.limit(0), it).count() == 0 and decontaminate.contained(d, it.limit(0)).count() == 0
    assert decontaminate.without_leaks(d, it.limit(0)).count() == len(docs)


def test_components_of_paths_stars_and_repeats(spark, monkeypatch):
    """Against plain search, where edges are contracted a few at a time and dealt to several tasks."""
    monkeypatch.setattr(simhash_near, "TASK_EDGES", 300)
    random.seed(8)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000 + i, 5000 + random.randrange(400)) for i in range(300)] + [(7, 7), (-5, 2**62), (2**62, -(2**62))]
    edges += random.choices(edges, k=100)
    random.shuffle(edges)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, left = {}, set(near)
    while left:
        found, new = set(), {min(left)}
        while new:
            found |= new
            new = {y for x in new for y in near[x]} - found
        want |= dict.fromkeys(found, min(found))
        left -= found
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for size in (1 << 18, 50):
        monkeypatch.setattr(simhash_near, "CONTRACTED", size)
        got = {r.node: r.label for r in simhash_near.components(df).collect()}
        # a node that only meets itself needs no label
        assert {k: got.get(k, k) for k in want} == want and set(got) <= set(want)
    assert simhash_near.components(df.limit(0)).count() == 0
