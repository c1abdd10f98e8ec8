"""Rows that a few others ask for, without a shuffle of the many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose 64-bit hashes are broadcast, some 30 MB at most; more are joined with the rows.
BROADCAST_KEYS = 1_000_000


def parted(rows: DataFrame, given: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """rows in two: those whose keys may be among the given ones, all that are being there, and the others. given is read once more, so it should be stored."""
    name = F.xxhash64(*keys).alias("_h")
    hashes = given.select(name).distinct()
    small = hashes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    asked = F.broadcast(hashes) if small else hashes
    named = rows.withColumn("_h", F.xxhash64(*keys))
    return tuple(named.join(asked, "_h", how).drop("_h") for how in ("left_semi", "left_anti"))


def narrowed(rows: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys may be among the given ones: all that are, and by chance of a hash some that are not."""
    return parted(rows, given, keys)[0]
