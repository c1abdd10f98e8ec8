from pyspark.sql import functions as F

from maskline.llm import simhash_near


def _jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


def test_few_edges_take_no_rounds(spark):
    """However long a path is, few edges take a fixed small number of jobs, and labels are the smallest nodes."""
    # the longest path there is, its edges in no order, and a star whose smallest node is a leaf
    path = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).orderBy(F.xxhash64("a"))
    star = spark.range(1, 500).select(F.lit(-7).cast("long").alias("a"), (-F.col("id") * 10).alias("b"))
    edges = path.unionByName(star).repartition(5, "b")
    before = _jobs(spark)
    found = simhash_near.components(edges, "v", "l")
    got = {r.v: r.l for r in found.collect()}
    assert _jobs(spark) - before <= 8
    assert got == {i: 0 for i in range(3001)} | {-10 * i: -4990 for i in range(1, 500)} | {-7: -4990}
    assert found.columns == ["v", "l"]
