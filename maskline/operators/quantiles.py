"""Exact quantiles of whole numbers by counting, without a group's values in one place.

Order statistics are narrowed down 16 bits at a time: a pass counts, for each group, the values in buckets of their
next 16 bits; running sums over at most 2^16 buckets tell which one holds a wanted rank, and the next pass counts
in there only. Counts are added up before they move, so a pass shuffles no more than its buckets, however many
rows there are. Two passes do for values that lie within 2^32 of each other, four for any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16
#: Wanted buckets that are broadcast to the rows; more are joined with them.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    """A table that is broadcast if it is small, which is looked at."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def order_statistics(rows: DataFrame, group: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """rows(group, value), wanted(group, rank), ranks from 0 -> (group, rank, value). Rows without a value don't count."""
    group = list(group)
    own = rows.select(*group, F.col(value).cast("long").alias("_v")).where("_v is not null")
    ends = own.agg(F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    low, bits = ends.low or 0, max(1, ((ends.high or 0) - (ends.low or 0)).bit_length())
    passes = -(-bits // DIGIT)
    # the bits of what a value is above the least, as a number that may use all 64
    own = own.select(*group, (F.col("_v") - F.lit(low)).alias("_v"))
    found = wanted.select(*group, "rank", F.col("rank").cast("long").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for p in reversed(range(passes)):
        top = F.lit(0).cast("long") if p == passes - 1 else F.shiftrightunsigned("_v", DIGIT * (p + 1))
        keyed = own.select(*group, top.alias("_prefix"), F.shiftrightunsigned("_v", DIGIT * p).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("_digit"))
        if p < passes - 1:
            keyed = keyed.join(_small(found.select(*group, "_prefix").distinct()), [*group, "_prefix"], "left_semi")
        counts = keyed.groupBy(*group, "_prefix", "_digit").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*group, "_prefix").orderBy("_digit"))
        sums = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n")).drop("_n")
        met = found.join(sums, [*group, "_prefix"]).where("_before <= _left and _left < _upto")
        found = met.select(*group, "rank", (F.col("_left") - F.col("_before")).alias("_left"), F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_digit")).alias("_prefix"))
    return found.select(*group, "rank", (F.col("_prefix") + F.lit(low)).alias(value))


def quantiles(rows: DataFrame, group: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """rows(group, value) -> (group, names): the values at these shares, between two neighbours by their distance; groups without a value have none.

    Without a group there is one row, whatever the rows.
    """
    group = list(group)
    each = rows if group else rows.withColumn("_all", F.lit(0))
    keys = group or ["_all"]
    sizes = each.groupBy(*keys).agg(F.count(value).alias("_n"))
    place: list[Column] = [(F.col("_n") - 1) * F.lit(float(q)) for q in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place])))
    wanted = sizes.where("_n > 0").select(*keys, F.explode(ranks).alias("rank"))
    found = order_statistics(each, keys, value, wanted).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("_at"))
    low, high = (lambda x: F.col("_at")[F.floor(x)].cast("double")), (lambda x: F.col("_at")[F.ceil(x)].cast("double"))
    between = [(low(x) + (high(x) - low(x)) * (x - F.floor(x))).alias(n) for x, n in zip(place, names)]
    out = sizes.join(found, keys, "left").select(*keys, *between)
    if group:
        return out
    one = rows.sparkSession.range(1).select(F.lit(0).alias("_all"))
    return one.join(out, "_all", "left").drop("_all")
