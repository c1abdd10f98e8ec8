import numpy as np
import pyarrow as pa

from maskline.llm import similar


def test_fingerprints_meet_in_the_ring_first(spark):
    """Pairs of the ring: all rows that fingerprints within four bits join are joined, and rows of one fingerprint with its first."""
    base = [0x0123456789ABCDEF, -0x0FEDCBA987654321, 0x00FF00FF00FF00FF]
    rows = [(i, 10, base[i % 3] ^ (0 if i < 6 else 0b111 << i)) for i in range(9)] + [(20, 100, base[0]), (21, 10, 0)]
    found = {(r.a, r.b) for r in similar.ring_pairs(spark.createDataFrame(rows, "row long, n long, print long")).collect()}
    label = {r: r for r, *_ in rows}
    for _ in rows:
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    # row 20 has too many shingles to be similar to any other
    assert [label[i] for i in range(9)] == [0, 1, 2] * 3 and label[20] == 20 and label[21] == 21


def test_links_come_from_the_ring_too(spark, monkeypatch):
    """Without MinHash keys that agree, near copies within four bits are still found, and only if their shingles are similar."""
    monkeypatch.setattr(similar, "band_keys", lambda h, begin: np.arange(len(begin) * similar.BANDS, dtype=np.uint64).reshape(-1, similar.BANDS) + np.uint64(h[0]))
    words = [f"w{i}" for i in range(900)]
    near = [*words[:450], "other", *words[451:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))], "doc_id long, text string").coalesce(1)
    assert bin(similar.set_print(_hashes(words)) ^ similar.set_print(_hashes(near))).count("1") <= 4
    assert sorted(r.doc_id for r in similar.one_of_each_similar(docs).collect()) == [1, 3]


def _hashes(words):
    return np.unique(similar.shingle_hashes(pa.array([" ".join(words)]), similar.SHINGLE)[1])
