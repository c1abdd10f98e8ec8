import pytest
from pyspark.sql import functions as F

from maskline.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_is_a_join_and_deals_hot_keys(spark, how):
    """A third of the rows have one key, another third none."""
    n = 9000
    many = common.keep(spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), (F.col("id") % 2).alias("l")))
    one = spark.range(0, n, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 14), (None, 1)], "k long, v long"))
    got = common.hot_join(many, one, "k", "id", how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, many.join(one, "k", how).select(*got.columns).collect()), key=str)
    both = one.withColumn("l", F.lit(1).cast("long"))
    got = common.hot_join(many, both, ["k", "l"], "id", how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, many.join(both, ["k", "l"], how).select(*got.columns).collect()), key=str)


def test_parts_of_hot_keys_are_bounded(spark, monkeypatch):
    """No part of a key holds much more than a share of the rows."""
    rows = common.keep(spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k")))
    seen = []
    join = type(rows).join
    monkeypatch.setattr(type(rows), "join", lambda self, other, on=None, how=None: (seen.append((self, on)), join(self, other, on, how))[1])
    common.hot_join(rows, spark.range(10).select(F.col("id").alias("k")), "k", "id").count()
    dealt = next(df for df, on in seen if on == ["k", "_part"])
    monkeypatch.undo()
    most = dealt.groupBy("k", "_part").count().agg(F.max("count")).first()[0]
    assert most < 1200
