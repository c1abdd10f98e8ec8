import gzip
import os
import random
import zlib
from datetime import datetime, timezone

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskline.llm import chat, packing, warc


def test_packing_is_exact_and_tight(spark):
    random.seed(1)
    texts = {0: None, 1: "", 2: "<|endoftext|> é😀\n\n  x <|endoftext|><|endoftext|>a \n<|endoftext|>\n\n b <|endoftext|"} | {i: " ".join(random.choice(["alpha", "be", "ca"]) for _ in range(random.randint(1, 2500))) for i in range(3, 90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in texts.items():
        ids = np.array(known.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        at = 0
        for r in own:
            assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in own[1:])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024
    assert len(bins) <= 1.1 * packing.best_fit_bound([r.length for r in rows]) + 2
    whole = packing.sequences(docs, packing.pack_documents(docs)).agg(F.sum(F.size("ids")).alias("n")).head().n
    assert whole == sum(r.length for r in rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_best_fit_takes_the_fullest_and_closes_it():
    bins = packing.BestFit(10, 2)
    assert [bins.add(n) for n in (6, 3, 1, 4)] == [(0, 0), (0, 6), (0, 9), (1, 0)]
    assert bins.add(8)[0] == 2 and bins.add(5)[0] == 1  # 1 (space 6) is fuller than nothing else that fits 5
    assert bins.add(9)[0] == 3


def test_best_fit_against_a_plain_scan():
    random.seed(2)
    for size, most in ((10, 2), (50, 5), (1024, 40)):
        bins, opened, made = packing.BestFit(size, most), [], 0  # opened: [free, bin], the newest last
        for _ in range(600):
            n = random.randint(1, size - 1)
            fits = [x for x in opened if x[0] >= n]
            if fits:
                best = min(x[0] for x in fits)
                chosen = [x for x in fits if x[0] == best][-1]
                opened.remove(chosen)
                free, own = chosen
            else:
                free, own, made = size, made, made + 1
            assert bins.add(n) == (own, size - free)
            if free - n:
                opened.append([free - n, own])
                if len(opened) > most:  # the fullest closes; of equal ones the newest
                    least = min(x[0] for x in opened)
                    opened.remove([x for x in opened if x[0] == least][-1])


def test_archives_round_trip(spark, tmp_path):
    big = "a" * 200
    rows = [(1, "u", big), (2, "v", big), (3, None, None), (None, "x\r\ny", big), (5, "z", "a" * 20), (6, "z", "a" * 20), (2, "v", big), (7, "q", "\r\n\r\nWARC/1.1 é" * 30)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")
    warc.write_archives(pages, f"{tmp_path}/w")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolved(warc.read_archives(spark, f"{tmp_path}/w")).collect()), key=str)
    assert got == sorted([(0, "response", None, 200), (1, "response", None, 200), (2, "revisit", 1, 200), (2, "revisit", 1, 200), (3, "response", None, 0), (5, "response", None, 20), (6, "response", None, 20), (7, "response", None, len(rows[-1][2].encode()))], key=str)


def test_archives_are_bounded_and_records_stand_alone(spark, tmp_path, monkeypatch):
    """The query against its SQL, on pages of which many have equal payloads, in archives of a few records each."""
    random.seed(4)
    shared = ["p" * 300, "q é" * 60, "", "short", None]
    rows = [(i, f"http://h/{i}", random.choice(shared) if i % 2 else f"own {i} " * random.randint(1, 60), i) for i in random.sample(range(3000), 900)]
    spark.createDataFrame(rows, "page_id long, url string, html string, size int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    seen = []
    monkeypatch.setattr(warc, "read_archives", lambda s, p, found=warc.read_archives: seen.append(p) or found(s, p))
    got = warc.op4_warc_revisit(spark, str(tmp_path))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.sql(f"SELECT {', '.join(names)} FROM ({warc.SQL})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == want
    assert sum(r[3] == "revisit" for r in want) > 100
    found = spark.read.format("binaryFile").load(seen[0]).select("path", "content").collect()
    files = [bytes(r.content) for r in found]
    assert all(r.path.endswith(".warc.gz") for r in found)
    assert len(files) > 20 and all(len(f) < 8000 for f in files)
    records = [m for f in files for m in warc.members(f)]
    assert len(records) == 900 and all(len(list(warc.parse(m))) == 1 for m in records)
    assert {h["WARC-Date"][:4] for m in records for h, _ in warc.parse(m)} == {str(datetime.now(timezone.utc).year)}
    assert sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == 900


def test_chats_round_trip(spark):
    odd = "\\ <\\| <| </s> <\\/s> [INST] \\\\[/INST] <|turn|> <|end|>"
    rows = [(1, 0, "user", [("text", odd, None, None), ("image", None, "a.png", 4), ("audio", None, "b", 3)]), (1, 1, "assistant", [("text", odd, None, None), ("other", None, "d", 2), ("text", "😀", None, None)]), (2, None, None, None), (None, 1, "<|body|>", [("text", None, None, None)])]
    messages = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    got = {r.conv_id: r for r in chat.format_chats(messages).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert got[1].turns[0].text == odd + "<|image|><|audio|>" and got[1].turns[1].text == odd + "<|document|>😀"
    assert [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "a.png", 1024), ("audio", "b", 75), ("document", "d", 1200)]
    assert all(got[1].formatted[a.start :].startswith(f"<|{a.kind}|>") for a in got[1].attachments) and got[1].attachment_tokens == 2299
    plain = [got[1].formatted[s.start : s.end] for s in got[1].loss]
    assert len(plain) == 2 and plain[1] == "😀" and "<|turn|>" not in plain[0]
    assert got[2].turns == [("", "")] and got[None].turns == [("<|body|>", "")] and got[2].loss == []


def test_a_failed_job_leaves_no_archive(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 50) for i in range(20)], "page_id long, url string, html string").repartition(4)
    bad = pages.withColumn("html", F.when(F.col("page_id") == 13, F.raise_error("stopped").cast("string")).otherwise(F.col("html")))
    with pytest.raises(Exception, match="stopped"):
        warc.write_archives(bad, f"{tmp_path}/w")
    assert not [x for _, _, names in os.walk(tmp_path) for x in names]
    warc.write_archives(pages, f"{tmp_path}/w")
    names = os.listdir(f"{tmp_path}/w")
    assert names and all(n.endswith(".warc.gz") for n in names)
    assert gzip.decompress(b"".join(open(f"{tmp_path}/w/{n}", "rb").read() for n in names)).count(b"WARC/1.1\r\n") == 20
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0
