import os
import re

from maskline.llm import similar, toxicity


def _shuffles(spark):
    """Shuffles that have files on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return set(re.findall(r"shuffle_(\d+)_\d+_\d+\.data", files))


def _texts(n):
    words = [f"w{i * 7919 % 1009}" for i in range(40 * n)]
    return [" ".join(words[40 * (i // 2) : 40 * (i // 2) + 40]) + f" end{i}" for i in range(n)]


def test_fitting_leaves_no_shuffles_or_broadcasts(spark):
    """Only what the kept sample was made from may stay until garbage is collected; rounds and their weights don't."""
    docs = spark.createDataFrame(list(enumerate(_texts(40))), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    shuffles, held = _shuffles(spark), set(os.listdir(spark.sparkContext._temp_dir))
    assert toxicity.train(docs, labels) is not None
    assert len(_shuffles(spark) - shuffles) <= 4
    assert set(os.listdir(spark.sparkContext._temp_dir)) <= held
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_near_duplicates_leave_few_shuffles(spark):
    """The search for groups leaves the shuffles of kept tables; its result is complete, and can be read again."""
    texts = _texts(60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shuffles = _shuffles(spark)
    found = similar.one_of_each_similar(docs)
    assert len(_shuffles(spark) - shuffles) <= 9
    expected = set(similar.brute_force(dict(enumerate(texts))).values())
    for _ in range(2):
        assert {r.doc_id for r in found.collect()} == expected
