"""Filter interaction audit: what each of five filters removes in every order, and its fair share.

A document is reduced to one number, the set of filters that it fails, and a part (source) to the counts of
its documents by that set. These counts are the part's removal polynomial: a multilinear function of five
variables, x_i being the chance that filter i is on, whose value is the expected number of documents removed,
sum over sets of n * (1 - product over the set of (1 - x_i)). Its corners are what a plain subset of the filters
removes, so they give each step of each order; the integral over the diagonal of its partial derivative is
the filter's Shapley value, with exact rationals; times 120 it is the sum over all orders.

Filters: A, under 50 words; B, 100 * distinct words < 65 * words; C, 100 * [A-Z] > 5 * characters; D, any of
# $ % & * |; E, the text of a smaller doc_id. Words are maximal runs of characters other than the six
ASCII spaces.

Copies: texts meet by SHA-256 as counts by (digest, part, labels), added up before the shuffle, so that
neither a hot part nor a text with any number of copies gathers in one task.

Cases: a null text is an empty one (which fails A, and E where repeated), a null source the part ""; a row
without doc_id has no smaller one, is none's smaller one and has no labels; rows that share a doc_id are documents
of their own, and the same text under the same doc_id is no copy; several labels of a doc_id count as their
largest; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES_RE, table

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
#: What is counted for each set of failed filters: documents, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")


def text_fails(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACES_RE), lambda w: w != "")
    fails = (
        lambda n, kinds: n < 50,
        lambda n, kinds: 100 * kinds < 65 * n,
        lambda n, kinds: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        lambda n, kinds: F.rlike(text, F.lit("[#$%&*|]")),
    )
    # the words are made once, as the one element of an array that the bits are taken from
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds")))
    bits = F.transform(sizes, lambda s: sum((F.when(f(s["n"], s["kinds"]), 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)))
    return bits[0]


def fail_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, source), labels(doc_id, quality, toxic) -> (part, fails, n, good, toxic): documents by the set of filters that they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), text_fails(text).alias("fails"),
        F.when(F.col("doc_id").isNull(), F.spark_partition_id() + 1).otherwise(0).alias("spread"),
    )
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic")).withColumn("spread", F.lit(0))
    known = rows.join(marks, ["doc_id", "spread"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    # first by doc_id, which the join has dealt them by, so that the smallest id comes with how many rows it has
    ids = known.groupBy("doc_id", "spread", "digest", "part", "fails", "quality", "toxic").agg(F.count("*").alias("k"))
    smallest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "k")))
    equal = ids.groupBy("digest", "part", "fails", "quality", "toxic").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("k")).otherwise(0)).alias("nameless"), smallest.alias("least"))
    # a text with its smallest id in all parts; a digest has as many rows here as it has parts and labels
    each = equal.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    originals = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.k")).otherwise(0)
    copy = F.lit(1 << FILTERS.index("E"))
    split = each.select("part", "quality", "toxic", F.inline(F.array(F.struct("fails", originals.alias("k")), F.struct((F.col("fails") + copy).alias("fails"), (F.col("n") - originals).alias("k")))))
    return split.groupBy("part", "fails").agg(F.sum("k").alias("n"), F.sum(F.col("quality") * F.col("k")).alias("good"), F.sum(F.col("toxic") * F.col("k")).alias("toxic"))


class Removal:
    """The multilinear polynomial of what filters remove: a coefficient for each set of variables."""

    def __init__(self, counts: dict[int, int]):
        self.terms: dict[int, int] = {}
        for fails, n in counts.items():
            subset = fails
            while subset:  # 1 - product of (1 - x_i), multiplied out
                self.terms[subset] = self.terms.get(subset, 0) + (n if subset.bit_count() % 2 else -n)
                subset = (subset - 1) & fails

    def corner(self, on: int) -> int:
        """Documents removed by these filters together."""
        return sum(c for subset, c in self.terms.items() if subset & ~on == 0)

    def shapley(self, i: int) -> Fraction:
        """Integral over t from 0 to 1 of the derivative by x_i where all variables are t."""
        return sum((Fraction(c, subset.bit_count()) for subset, c in self.terms.items() if subset >> i & 1), Fraction(0))


def _orders(part: str, counts: dict[str, dict[int, int]]) -> Iterator[tuple]:
    """The rows of a part: each order, each step."""
    total = sum(counts["n"].values())
    every = (1 << len(FILTERS)) - 1
    corner = {}
    for name in COUNTS:
        removal = Removal(counts[name])
        corner[name] = [removal.corner(on) for on in range(every + 1)]
        if name == "n":
            shares = [removal.shapley(i) * ORDERS for i in range(len(FILTERS))]
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (corner[name][after] - corner[name][before] for name in COUNTS)
            failing = corner["n"][1 << i]
            alone = corner["n"][every] - corner["n"][every ^ 1 << i]
            yield part, "".join(FILTERS[j] for j in order), step, total - corner["n"][after], removed, failing - removed, alone, good, toxic, int(shares[i])
            before = after


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audit(pdf: pd.DataFrame) -> pd.DataFrame:
    """The at most 32 counts of a part."""
    counts = {name: dict(zip(pdf["fails"].tolist(), pdf[name].tolist())) for name in COUNTS}
    return pd.DataFrame(list(_orders(pdf["part"].iloc[0], counts)), columns=[c.split()[0] for c in AUDIT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: see AUDIT."""
    return fail_counts(docs, labels).groupBy("part").applyInPandas(_audit, AUDIT)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SPACES = r"[\x20\x09-\x0D]+"
SQL = rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda x: x <> '') AS words FROM t),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS e FROM w),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
k AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY 1, 2),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o AS (SELECT p.name || q.name || r.name || s.name || t.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM l p, l q, l r, l s, l t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
x AS (SELECT filter_order, i AS step, bits[i] AS own, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS earlier FROM o, unnest(range(1, 6)) AS u(i)),
y AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (fails & (earlier | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & own > 0 AND fails & earlier = 0), 0) AS removed, coalesce(sum(n) FILTER (fails & own > 0 AND fails & earlier > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails, coalesce(sum(good) FILTER (fails & own > 0 AND fails & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & own > 0 AND fails & earlier = 0), 0) AS toxic_lost
  FROM k, x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))}, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y"""
