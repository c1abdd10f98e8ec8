"""Finding literals: an Aho-Corasick automaton passes over a text once, however many literals there are.

All occurrences count, overlapping ones too, of one literal and of several. Places are codepoints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the names of one automaton, on average, and occurrences that a task holds before it passes them on.
NAME_CHARS, HELD = 1 << 20, 1 << 16


def automaton(literals: Iterable[str]) -> ahocorasick.Automaton | None:
    """Of the literals that are not empty, numbered in their order; None without any."""
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for i, literal in enumerate(literals):
        if literal:
            found.add_word(literal, (i, len(literal)))
    if not len(found):
        return None
    found.make_automaton()
    return found


def _with(df: DataFrame, field: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.DataType.fromDDL(field).fields])


def occurrences(texts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """texts(keep, text, literals array<struct<literal, labels array<string>>>) -> (keep, start, end, label): each label of a literal at its every occurrence.

    A text goes through its own automaton in one pass. A text's literals differ; null and empty ones, and null texts, have no occurrence.
    """

    def run(batches):
        for batch in batches:
            base = batch.select(list(keep))
            rows, starts, ends, labels = [], [], [], []

            def out() -> pa.RecordBatch:
                taken = base.take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([*taken.columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(labels, pa.string())], names=[*keep, "start", "end", "label"])

            for i, (text, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("literals").to_pylist())):
                machine = automaton([x["literal"] for x in own or ()])
                for last, (number, size) in machine.iter(text) if machine is not None and text else ():
                    for label in own[number]["labels"]:
                        rows.append(i)
                        starts.append(last - size + 1)
                        ends.append(last + 1)
                        labels.append(label)
                    if len(rows) >= HELD:
                        yield out()
                        rows, starts, ends, labels = [], [], [], []
            if rows:
                yield out()

    return texts.select(*keep, "text", "literals").mapInArrow(run, _with(texts.select(*keep), "start int, end int, label string"))


def _named(given, name: str):
    """Rows (..., text) -> the same and `name`, those of the given names that are in the text, in their order."""

    def run(batches):
        names = given.value
        machine = automaton(names)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                found.append([names[i] for i in sorted({i for _, (i, _) in machine.iter(text)})] if machine is not None and text else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, name])

    return run


def name_shards(names: DataFrame) -> Iterator[list[str]]:
    """Different names(name) in lists that fit into a broadcast, NAME_CHARS characters on average; each the longest first.

    A name's list is its hash's, so a longest name may be in any.
    """
    own = names.select("name").where(F.length("name") > 0).distinct()
    chars = own.agg(F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-chars // NAME_CHARS))
    for shard in range(shards):
        rows = own.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard).collect()
        yield sorted((r.name for r in rows), key=lambda n: (-len(n), n))


def with_names(texts: DataFrame, names: DataFrame | Sequence[str], field: str) -> DataFrame:
    """texts(..., text) with `field`, those of the names that it contains.

    names: a list, whose order they then have, or names(name) of any number, in lists of bounded size; they are then
    in the order of their length, the longest first, equal ones by themselves. Every list passes over a text once.
    """
    lists = name_shards(names) if isinstance(names, DataFrame) else [list(dict.fromkeys(n for n in names if n))]
    out, fields = texts, []
    for i, names_ in enumerate(lists):
        fields.append(f"{field}_{i}")
        out = out.mapInArrow(_named(texts.sparkSession.sparkContext.broadcast(names_), fields[-1]), _with(out, f"{fields[-1]} array<string>"))
    found = F.flatten(F.array(*fields))
    if len(fields) > 1:
        found = F.transform(F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda x: x["x"])
    return out.withColumn(field, found).drop(*fields)


def name_hits(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts(..., text), names(name) -> (... without text, exact_text): a row for each different name in each text."""
    rest = [c for c in texts.columns if c != "text"]
    return with_names(texts, names, "_names").select(*rest, F.explode("_names").alias("exact_text"))
