"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words, everywhere in this subpackage, are maximal runs of bytes other than these six.
SPACES = b" \t\n\x0b\x0c\r"

#: The same six as a Java regular expression.
SPACES_RE = "[\\x20\\x09-\\x0D]+"

#: Bytes of text that a Python task turns into arrays at once.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a local session gets one under its warehouse, which it has to itself; on
    a cluster that is an error, as a folder of one machine would be seen by no other.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of our own below the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Keep what later steps read more than once, on disk; a lost part is computed again from its input."""
    return df.persist(StorageLevel.DISK_ONLY)


#: Spark's own setting for it, since 4.1.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files go when it ends, and not when the driver happens to collect its garbage.

    For actions whose result stays elsewhere, such as checkpoints; kept tables keep their shuffles, so lost parts can still be computed again.
    """
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


@contextmanager
def lent(spark: SparkSession, value) -> Iterator[Broadcast]:
    """A broadcast for actions inside: after them no disk or memory holds a copy."""
    given = spark.sparkContext.broadcast(value)
    try:
        yield given
    finally:
        given.destroy()


#: Bits of a row's second key where it has to share a long with a place, as in `repeats.py`.
TIE_BITS = 12


def row_keys(*cols: str, bits: int = 64, seed: int = 0) -> list[Column]:
    """A row's `doc_key` and `tie`, 64 bits of its contents each (of the tie fewer where asked for), nulls included; equal rows share them."""
    parts = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    key, tie = F.xxhash64(F.lit(2 * seed), *parts), F.xxhash64(F.lit(2 * seed + 1), *parts)
    return [key.alias("doc_key"), (tie if bits == 64 else tie.bitwiseAND(F.lit((1 << bits) - 1))).alias("tie")]


def as_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as (row, more...): what a row has besides its text in one column, so that no name of theirs meets a name of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), *more)


def keyed_rows(docs: DataFrame, bits: int = 64) -> DataFrame:
    """docs as (row, text, doc_key, tie); maps have no hash and are no part of the keys.

    Names of 128 bits are taken as they are. Shorter ones are looked at first: where two rows that differ in another 64
    bits share one, all rows get other names.
    """
    names = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    seed = 0
    while bits < 64 and names and _shared(docs, names, bits, seed):
        seed += 1
    return as_rows(docs, F.col("text"), *row_keys(*names, bits=bits, seed=seed))


def _shared(docs: DataFrame, names: list[str], bits: int, seed: int) -> bool:
    """Whether different rows share a name."""
    other = F.xxhash64(F.lit("other"), *[x for c in names for x in (F.col(c), F.col(c).isNull())]).alias("other")
    ends = docs.select(*row_keys(*names, bits=bits, seed=seed), other).groupBy("doc_key", "tie").agg(F.min("other").alias("a"), F.max("other").alias("b"))
    return bool(ends.where("a <> b").head(1))


def unkeyed(done: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """done(row, text, ...) in the columns of docs, of which some may get new values."""
    return done.select(*[changed.get(c, F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


#: Parts into which `spread_join` deals the rows of a key.
SPREAD = 16


def spread_join(many: DataFrame, one: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """many join one, which has a row for each key, where a key may hold any share of `many`: its rows are dealt by `by`."""
    dealt = many.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SPREAD)))
    copies = one.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return dealt.join(copies, [*([key] if isinstance(key, str) else key), "_part"], how).drop("_part")


#: At most so many keys have more than this part of the rows.
HOT_KEYS = 1000


def hot_join(many: DataFrame, one: DataFrame, keys: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """many join one, "inner" or "left", where a key may hold any share of `many`, which must be kept or cheap to read again.

    A key with more than a thousandth of the rows has them dealt by `by` to as many parts, each with a copy of what
    `one` has for the key; there are at most HOT_KEYS such keys, so their list can be broadcast. Rows whose key is null
    match nothing and are dealt alike.
    """
    keys = [keys] if isinstance(keys, str) else keys
    counts = keep(many.groupBy(*keys).agg(F.count("*").alias("_n")))
    share = max(1000, -(-(counts.agg(F.sum("_n").alias("n")).first().n or 0) // HOT_KEYS))
    hot = F.broadcast(counts.where(F.col("_n") > share).select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_parts")).dropna())
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    number = F.xxhash64(by, F.spark_partition_id())
    dealt = many.withColumn("_at", number).join(hot, keys, "left")
    dealt = dealt.withColumn("_part", F.when(none, F.pmod("_at", F.lit(HOT_KEYS))).otherwise(F.pmod("_at", F.coalesce("_parts", F.lit(1)))).cast("int")).drop("_at", "_parts")
    copies = one.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, leaves this remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, slice) pieces of an Arrow text column of about `limit` bytes each, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n, first, size = len(texts), 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i in range(n):
        if size and size + sizes[i] > limit:
            yield first, texts.slice(first, i - first)
            first, size = i, 0
        size += sizes[i]
    if first < n:
        yield first, texts.slice(first, n - first)


def slices(batches, rows: int = 512):
    """The same batches in smaller pieces: what a task makes of a piece is gone before the next."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def schema_with(df: DataFrame, *more: str) -> T.StructType:
    """The schema of a DataFrame with further columns ("name type")."""
    return T.StructType([*df.schema.fields, *T.DataType.fromDDL(", ".join(more)).fields])


def extended(batch: pa.RecordBatch, drop: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch without its last `drop` columns and with new ones."""
    n = batch.num_columns - drop
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *columns.values()], names=[*batch.schema.names[:n], *columns])


def pack_texts(docs: DataFrame, *carry: str) -> DataFrame:
    """docs(carry, text) with the text, or "" for null, as a zstd frame, `packed`: less than half to shuffle."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()
            yield extended(batch, 1, packed=pa.array([press(x) for x in texts], pa.binary()))

    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema_with(docs.select(*carry), "packed binary"))


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(packed))
