"""WARC archives in which equal payloads are stored once.

Payload digests go out as headers only; for each digest of a large enough payload the smallest page id
is the response and every other record a revisit of it; pages of a digest that many share are dealt to many parts.
Payloads then meet their decision by page id, so they are spread out, and only responses are written with theirs. Archives are
WARC/1.1 files with fresh headers, every record a gzip member of its own, so that it can be read alone.
A task fills archives of `ARCHIVE_BYTES` (more only for a single larger record), `*.warc.gz` of such members and nothing
else, in a folder of its attempt; the job's commit moves those of the attempts that count into place, its abort removes
all. They are read back as binary files, a member at a time.

Cases: a null payload is empty; payloads under `SMALLEST` bytes are always responses; rows with the same
page id and payload are all responses if that id is the smallest; pages without an id are always
responses and no one's original; line breaks in URLs are percent-encoded and a null URL is empty; extra
columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.tree import moved, opened
from .common import hot_join, keep, scratch_dir, table

SMALLEST = 100
ARCHIVE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = "\r\n"
#: Bytes that are decompressed at once.
_CHUNK = 1 << 16


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def decisions(headers: DataFrame) -> DataFrame:
    """headers(page_id, url, digest, size) -> distinct (page_id, digest, first_id, first_url): the response to revisit, or nulls."""
    named = headers.where((F.col("size") >= SMALLEST) & F.col("page_id").isNotNull())
    firsts = named.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("f")).select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"))
    found = hot_join(keep(named.select("page_id", "digest").distinct()), firsts, "digest", "page_id")
    return found.where("page_id <> first_id")


def records(pages: DataFrame, date: str, payload: str = "html") -> DataFrame:
    """pages(page_id, url, payload) -> one WARC record each, as a string of bytes; date: when they are written."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("size"))
    seen = decisions(rows.select("page_id", "url", "digest", "size"))
    joined = rows.join(seen, ["page_id", "digest"], "left")
    again = F.col("first_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}Content-Length: "), F.col("size").cast("string"), F.lit(_BREAK * 2))
    block = F.when(again, http).otherwise(F.concat(http, "body"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_BREAK))
    head = [
        F.lit(f"WARC/1.1{_BREAK}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(""),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("first_id"), F.col("digest"))), line("WARC-Refers-To-Target-URI", F.col("first_url")), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_BREAK),
    ]
    return joined.select(F.concat(*head, block, F.lit(_BREAK * 2)).alias("record"))


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    archives: int


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (record) as archives; path is a URI of a folder that driver and executors see."""

    def __init__(self, path: str, limit: int):
        self.path, self.limit, self.staged = path, limit, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, root = opened(self.path)
        own, made, file, size = f"{root}/{self.staged}/{uuid.uuid4().hex}", 0, None, 0
        try:
            for batch in iterator:
                for record in batch.column(0).cast(pa.binary()).to_pylist():
                    member = gzip.compress(record, mtime=0)
                    if file is not None and size + len(member) > self.limit:
                        file.close()
                        file = None
                    if file is None:
                        system.create_dir(own, recursive=True)
                        file, size = system.open_output_stream(f"{own}/pages-{uuid.uuid4().hex}.warc.gz", compression=None), 0
                        made += 1
                    file.write(member)
                    size += len(member)
        finally:
            if file is not None:
                file.close()
        return _Written(own, made)

    def _clear(self) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.staged}").type == FileType.Directory:
            system.delete_dir(f"{root}/{self.staged}")

    def commit(self, messages):
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.archives:
                moved(system, m.folder, root)
        self._clear()

    def abort(self, messages):
        self._clear()


class ArchiveSink(DataSource):
    @classmethod
    def name(cls):
        return "warc_archives"

    def schema(self):
        return "record string"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are added to a folder; it is not overwritten")
        return ArchiveWriter(self.options["path"], int(self.options["archiveBytes"]))


def write_archives(pages: DataFrame, path: str, payload: str = "html", date: str | None = None) -> None:
    """Write the pages' records to WARC files in a folder, all or none; date is the present by default, the same for all."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages.sparkSession.dataSource.register(ArchiveSink)
    records(pages, date, payload).write.format("warc_archives").option("archiveBytes", ARCHIVE_BYTES).mode("append").save(path)


def members(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed one by one."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        one, parts = zlib.decompressobj(wbits=31), []
        while not one.eof:
            chunk = view[at : at + _CHUNK]
            if not len(chunk):
                raise ValueError("an archive is cut short")
            parts.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes):
    """(headers, block) of each record in these bytes."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split(_BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) != size or raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        at += 4
        yield head, block


def _read(batches):
    for pdf in batches:
        for content in pdf["content"]:
            out = []
            for head, block in (x for m in members(bytes(content)) for x in parse(m)):
                http, payload = block.split(b"\r\n\r\n", 1)
                size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {head['WARC-Record-ID']} is not what its headers say")
                page = head.get("X-Page-Id")
                out.append((None if page is None else int(page), head["WARC-Record-ID"], head["WARC-Type"], head["WARC-Target-URI"], digest, size, head.get("WARC-Refers-To"), payload if head["WARC-Type"] == "response" else None))
            names = ["page_id", "record_id", "record_type", "url", "payload_digest", "payload_bytes", "refers", "payload"]
            yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of archives; revisits have the id of the record they refer to, and no payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInPandas(_read, "page_id long, record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers string, payload binary")


def resolved(read: DataFrame) -> DataFrame:
    """Records without payloads, revisits with the page id of the response they refer to."""
    heads = keep(read.drop("payload"))
    originals = heads.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers")).agg(F.min("page_id").alias("refers_to"))
    revisits = hot_join(heads.where("record_type = 'revisit'"), originals, "refers", "record_id", "left").drop("refers")
    return heads.where("record_type <> 'revisit'").drop("refers").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def op4_warc_revisit(spark, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {SMALLEST} GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""
