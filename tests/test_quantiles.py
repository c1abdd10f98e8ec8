import random

import pytest
from pyspark.sql import functions as F

from maskline.operators import quantiles as q


def _want(values, share):
    if not values:
        return None
    k = (len(values) - 1) * share
    low, values = int(k), sorted(values)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (k - low)


SHARES, NAMES = (0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0), [f"s{i}" for i in range(7)]


@pytest.mark.parametrize("kind", ["small", "ties", "wide", "negative"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_groups_against_sorting(spark, monkeypatch, kind, broadcast):
    if not broadcast:
        monkeypatch.setattr(q, "BROADCAST_ROWS", -1)
    random.seed(4)
    draw = {"small": lambda: random.randint(0, 9), "ties": lambda: random.choice([5, 5, 5, 70_000]), "wide": lambda: random.choice([0, random.getrandbits(62), -random.getrandbits(61)]), "negative": lambda: random.randint(-100_000, -90_000)}[kind]
    rows = [(g, draw() if random.random() < 0.95 else None) for g, n in (("a", 101), ("b", 64), ("c", 1), ("d", 2)) for _ in range(n)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(3)
    got = {r.g: tuple(r)[1:] for r in q.quantiles(df, ["g"], "v", SHARES, NAMES).collect()}
    for g in {g for g, _ in rows}:
        values = [v for x, v in rows if x == g and v is not None]
        assert got[g] == pytest.approx([_want(values, s) for s in SHARES]) if values else got[g] == (None,) * 7
    assert len(got) == 5


def test_same_as_percentile(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 100_000).alias("v"))
    got = q.quantiles(df, ["g"], "v", SHARES, NAMES).orderBy("g").collect()
    want = df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("p")).orderBy("g").collect()
    assert [list(r)[1:] for r in got] == [pytest.approx(r.p) for r in want]


def test_whole_tables(spark):
    df = spark.createDataFrame([(7,), (9,)], "v int")
    assert tuple(q.quantiles(df, (), "v", (0.25, 0.5), ("a", "b")).head()) == (7.5, 8.0)
    assert tuple(q.quantiles(df.limit(1), (), "v", (0.25, 0.5), ("a", "b")).head())[0] in (7.0, 9.0)
    assert [tuple(r) for r in q.quantiles(df.limit(0), (), "v", (0.5,), ("a",)).collect()] == [(None,)]
    assert q.quantiles(df.withColumn("g", F.lit(1)).limit(0), ["g"], "v", (0.5,), ("a",)).count() == 0


def test_order_statistics_move_buckets_only(spark):
    """A hundred thousand values of one group leave their tasks as counts."""
    df = spark.range(0, 100_000, 1, 4).select(F.lit(1).alias("g"), (F.col("id") % 500 * 1000).alias("v"))
    wanted = spark.createDataFrame([(1, 0), (1, 50_000), (1, 99_999)], "g int, rank long")
    got = q.order_statistics(df, ["g"], "v", wanted)
    assert sorted((r["rank"], r.v) for r in got.collect()) == [(0, 0), (50_000, 250_000), (99_999, 499_000)]
