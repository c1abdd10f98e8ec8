import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def given():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def _texts():
    random.seed(4)
    parts = ["a", "th", "e", "ing", " ", "  ", "\n", "\t", "'s", "'S", "1", "23", "\u00e9", "\u00f1", "\U0001f600", "\u0301", "<|endoftext|>", "<|endof", "x" * 9, "\u0120", "#$%", "\u00a0", "\u3000", "\x1c"]
    made = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(600)]
    return ["", " ", "<|endoftext|>", "a" * 5000, "".join(random.choice("abcdefgh") for _ in range(300_000)), "word " * 40_000, *made]


def test_same_ids_and_text_as_the_library(spark, given, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100_000)
    texts = [None, *_texts()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode_documents(docs, "doc_id")
    got = {r.doc_id: r.ids for r in encoded.collect()}
    want = [given.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded, "doc_id").collect()}
    assert [back[i] for i in range(len(texts))] == [given.decode(x, skip_special_tokens=False) for x in want]
    assert bpe.encode_documents(docs.limit(0), "doc_id").count() == 0


def test_forgetting_words_and_turns_change_nothing(given, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 2000)
    monkeypatch.setattr(bpe, "TURN_WORDS", 7)
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    encoder, texts = bpe.Encoder(PATH), _texts()[6:200]
    for i in range(0, len(texts), 9):
        ids, sizes = encoder.encode(texts[i : i + 9])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [given.encode(t, add_special_tokens=False).ids for t in texts[i : i + 9]]


def test_proposals_are_verified():
    """Words of which each kind occurs: proposals that hold and proposals that do not; both ways of merging agree."""
    known = bpe.vocabulary(PATH)
    random.seed(9)
    words = list({"".join(random.choice(["th", "e", "re", "in", "g", "s", "ly", "con", "qu"]) for _ in range(random.randint(1, 6))).encode() for _ in range(2000)})
    ids, sizes, exact = known.encode_words(words)
    found = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert found == [known.merged(w) for w in words]
    assert 0 < exact < len(words)
    word, token = known.exactly(words)
    assert [token[word == i].tolist() for i in range(50)] == found[:50]


def test_every_pair_of_a_small_vocabulary(tmp_path):
    """compatible() against merging, for all pairs; and a file whose merges are in an untrained order."""
    letters = {v: k for k, v in bpe._byte_of().items()}
    vocab = {letters[b]: b for b in range(256)}
    merges = []
    random.seed(3)
    for _ in range(60):
        a, b = random.choice([t for t in vocab if set(t) <= set("ab")]), random.choice([t for t in vocab if set(t) <= set("ab")])
        if a + b not in vocab and len(a + b) < 9:
            vocab[a + b] = len(vocab)
            merges.append([a, b])
    for name, order in (("trained", merges), ("untrained", merges[::-1])):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps({"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "model": {"type": "BPE", "vocab": vocab, "merges": order}}))
        known, given = bpe.Vocabulary(str(path)), Tokenizer.from_file(str(path))
        assert known.trained == (name == "trained")
        words = ["".join(random.choice("ab") for _ in range(random.randint(1, 14))) for _ in range(400)]
        ids, sizes, _ = known.encode_words([w.encode() for w in words])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [given.encode(w).ids for w in words]
        own = [i for i in vocab.values() if known.own[i]]
        if known.trained:
            a, b = (x.ravel() for x in np.meshgrid(own, own))
            assert known.compatible(a, b).tolist() == [known.merged(known.bytes[x] + known.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]


def test_query_digests(spark, given, tmp_path):
    texts = [None, "", "Hello  world\n", "\u00f1andu <|endoftext|> x"]
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op12_bpe_codec(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = given.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))
