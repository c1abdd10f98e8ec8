import os

import pytest
from pyspark.sql import functions as F

from maskline.functions.constants import PASSES
from maskline.operators.extract import PatternExtractor
from maskline.operators.gold import gold_records
from maskline.plans.deidentify import deidentify
from maskline.sources import readers, sinks, tree

from .fixture import NAMES, frames


def _files(folder):
    return [f"{d}/{x}" for d, _, names in os.walk(folder) for x in names]


def _rows(df):
    return sorted(map(str, df.collect()))


def test_a_packed_tree_says_the_same_in_few_files(spark, tmp_path):
    notes, _, _ = frames(spark)
    many = notes.crossJoin(spark.range(40).withColumnRenamed("id", "i")).select(F.concat("doc_id", F.lit("-"), F.col("i").cast("string")).alias("doc_id"), F.concat("text", F.lit("é")).alias("text"))
    run = deidentify(many.withColumn("model_id", F.lit("m")), PatternExtractor(NAMES))
    loose, packed = f"{tmp_path}/loose", f"{tmp_path}/packed"
    assert sinks.write_tree(loose, run.notes, run.responses, run.validations, run.spans) == sinks.write_tree(packed, run.notes, run.responses, run.validations, run.spans, packed=True)
    for read in (readers.read_predictions, readers.read_responses, readers.read_validations, readers.read_contents, readers.list_documents, readers.discover_models):
        assert _rows(read(spark, loose)) == _rows(read(spark, packed)) != []
    # files and folders take a block each: packed ones are as many as tasks and folders, not as notes
    assert len(_files(loose)) >= 6 * many.count() and len(_files(packed)) < many.count()
    assert all(x.endswith(tree.PACKED) for x in _files(packed))
    one = lambda out: readers.read_predictions(spark, out).where(f"pass = '{PASSES[1]}' and doc_id in ('N1-3', 'N3-7')")
    assert _rows(one(loose)) == _rows(one(packed)) != []
    assert readers.read_predictions(spark, packed).where("doc_id = 'none' or model_id = 'none'").count() == 0
    with pytest.raises(Exception, match="new folders only"):
        sinks.write_tree(packed, run.notes, run.responses, run.validations, run.spans, packed=True)
    assert _rows(readers.read_responses(spark, loose)) == _rows(readers.read_responses(spark, packed))


def test_archives_are_bounded(tmp_path, monkeypatch):
    """A task closes an archive that is full, and the oldest of too many."""
    monkeypatch.setattr(tree, "FILE_BYTES", 4096)
    monkeypatch.setattr(tree, "OPEN", 2)
    system, root = tree.opened(str(tmp_path))
    packer = tree._Packer(system, root)
    want = {}
    for i in range(30):
        name = f"{'long' * 40}{i}/x.json"
        packer.add(f"f{i % 3}", name, str(i).encode() * 500)
        want[(f"f{i % 3}", name)] = str(i) * 500
        assert len(packer.open) <= 2
    packer.close()
    got = {(f"f{k}", n): v for k in range(3) for path in tree.archives(system, f"{root}/f{k}") for n, v in tree.members(system, path)}
    assert got == want and len(_files(tmp_path)) == 30


def test_packed_gold(spark, tmp_path):
    notes, _, _ = frames(spark)
    records = gold_records(notes, spark.createDataFrame([("N1", "a", "01_NAME")], "doc_id string, exact_text string, identifier_type string").where("false"), "x")
    loose, packed = f"{tmp_path}/loose", f"{tmp_path}/packed"
    assert sinks.write_gold(records, loose) == sinks.write_gold(records.coalesce(1), packed, packed=True)
    assert len(_files(packed)) == 1 < len(_files(loose))
    for a, b in zip(readers.read_gold(spark, loose), readers.read_gold(spark, packed)):
        assert _rows(a) == _rows(b)
