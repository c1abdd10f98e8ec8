"""Ranked lexical search: sort-based accumulation of impacts, exact top k for each item.

Every document is cut into terms once; of these the ones that some item has are kept as (term, tf). From them come
the statistics, over all documents: N, L and each term's df. Then a task takes its documents in blocks: the
impacts of a block's postings are laid out for all items that have the term, as (item, document) packed into one
key; the keys are radix sorted in digits of 16 bits, equal ones are summed by reduceat, and each item's best go
to a heap of k. What the tasks' heaps hold, k rows an item at most, is range-partitioned by (item, document), so
that no item's rows meet in one task, selected by heaps once more, and ranked.

Items are taken in blocks of bounded size, each of which sees all documents; only a block's terms are ever broadcast.

Cases: a null text has no terms, as has one of separators only, and is not counted in N; rows that share a doc_id are
documents of their own; a row without doc_id counts, may be found, and comes after others of its score; items that
share an item_id are ranked each for itself, items without terms, or whose terms no document has, have no rows;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, slices, table

TOP = 20
#: Terms, and items, of a block of items on average; the latter at most half of 2^16.
ITEM_TERMS, ITEMS = 1 << 18, 1 << 14
#: Impacts that are sorted at once, and bytes of a text that are cut into terms at once.
IMPACTS, PIECE_BYTES = 1 << 20, 1 << 22

#: Letters, digits and all bytes of characters beyond ASCII make terms; A to Z are lower-cased.
_TERM_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@dataclass
class Items:
    """A block of items: their terms' numbers, and for each term the items that have it and how often."""

    ids: list  # item_id by item
    number: dict[bytes, int] = field(default_factory=dict)
    starts: np.ndarray | None = None  # of each term's items
    items: np.ndarray | None = None
    times: np.ndarray | None = None
    weights: np.ndarray | None = None  # of each term, once its df is known

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        out, pairs = cls([r[0] for r in rows]), {}
        for item, (_, text) in enumerate(rows):
            for part in terms(text):
                for t in part:
                    key = out.number.setdefault(t, len(out.number)), item
                    pairs[key] = pairs.get(key, 0) + 1
        found = sorted(pairs)
        term = np.array([t for t, _ in found], np.int64)
        out.starts = np.searchsorted(term, np.arange(len(out.number) + 1))
        out.items = np.array([i for _, i in found], np.int64)
        out.times = np.array([pairs[x] for x in found], np.int64)
        return out


def _postings(given):
    """(doc_id, n, terms, tfs) of every document with terms; terms and tfs are 32-bit and 64-bit numbers."""

    def run(batches):
        number = given.value
        for batch in slices(batches):
            ids, sizes, found, counts = [], [], [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, known = 0, [np.zeros(0, np.int64)]
                for part in terms(text):
                    n += len(part)
                    known.append(np.array([i for i in map(number.get, part) if i is not None], np.int64))
                if n:
                    term, tf = np.unique(np.concatenate(known), return_counts=True)
                    ids.append(doc_id)
                    sizes.append(n)
                    found.append(term.astype("<u4").tobytes())
                    counts.append(tf.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return run


def _tally(size: int):
    """A task's sums: df by term, and N and L as terms -1 and -2."""

    def run(batches):
        df, n, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n += batch.num_rows
            total += sum(batch.column("n").to_pylist())
            for b in batch.column("terms").to_pylist():
                df[np.frombuffer(b, "<u4")] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(at, [-1, -2]).astype(np.int64), "many": np.append(df[at], [n, total])})

    return run


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, by digits of 16 bits, lowest first; numpy sorts these by counting."""
    order = np.arange(len(keys))
    for shift in range(0, int(keys.max(initial=0)).bit_length(), 16):
        digit = (keys[order] >> np.uint64(shift)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


class Heaps:
    """The best `top` documents of each item: higher scores, then lower ids, then rows without one."""

    def __init__(self, top: int):
        self.top, self.heaps, self.least = top, {}, np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        """Offer rows; those of score 0 are none."""
        if len(item) and item.max() >= len(self.least):
            self.least = np.append(self.least, np.ones(int(item.max()) + 1 - len(self.least), np.int64))
        at = np.flatnonzero(score >= self.least[item])
        if len(at) > self.top:
            at = at[np.lexsort((doc_id[at], null[at], -score[at], item[at]))]
            own = item[at]
            first = np.append(True, own[1:] != own[:-1])
            at = at[np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1] < self.top]
        for i, s, d, n in zip(item[at].tolist(), score[at].tolist(), doc_id[at].tolist(), null[at].tolist()):
            heap = self.heaps.setdefault(i, [])
            if len(heap) < self.top:
                heapq.heappush(heap, (s, not n, -d))
            else:
                heapq.heappushpop(heap, (s, not n, -d))
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        found = [(i, s, -d if named else None) for i, heap in self.heaps.items() for s, named, d in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], names=["item", "score", "doc_id"])


FOUND = "item long, score long, doc_id long"


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids with 0 for null, and which are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def accumulate(items: Items, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) from the impacts of a block's postings."""
    sizes = items.starts[term + 1] - items.starts[term]
    at = np.repeat(items.starts[term] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    keys = (items.items[at] << 16 | np.repeat(doc, sizes)).astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    values = (items.times[at] * np.repeat(impact, sizes))[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return (keys[first] >> np.uint64(16)).astype(np.int64), (keys[first] & np.uint64(0xFFFF)).astype(np.int64), np.add.reduceat(values, first) if len(first) else values


def _search(given, n_docs: int, n_terms: int, top: int):
    """Scores of a task's documents for every item of the block."""

    def run(batches):
        items, best = given.value, Heaps(top)
        wide = np.diff(items.starts)
        for batch in slices(batches, 1 << 15):
            term = [np.frombuffer(b, "<u4").astype(np.int64) for b in batch.column("terms").to_pylist()]
            tf = [np.frombuffer(b, "<i8") for b in batch.column("tfs").to_pylist()]
            ids, null = _ids(batch.column("doc_id"))
            m = 75 + (25 * n_docs * batch.column("n").to_numpy()) // n_terms
            ends = np.cumsum([wide[t].sum() for t in term])
            at = 0
            while at < len(term):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + IMPACTS, "right")))
                own = np.concatenate(term[at:end])
                doc = np.repeat(np.arange(end - at), [len(t) for t in term[at:end]])
                times = np.concatenate(tf[at:end])
                impact = items.weights[own] * ((1_000_000_000 * times) // (1000 * times + 12 * m[at:end][doc]))
                item, doc, score = accumulate(items, own, doc, impact)
                best.add(item, score, ids[at:end][doc], null[at:end][doc])
                at = end
        yield best.rows()

    return run


def _select(top: int):
    def run(batches):
        best = Heaps(top)
        for batch in batches:
            best.add(batch.column("item").to_numpy(), batch.column("score").to_numpy(), *_ids(batch.column("doc_id")))
        yield best.rows()

    return run


def _how_many(text: Column) -> Column:
    """A bound of how many terms a text has."""
    return F.octet_length(F.coalesce(text, F.lit(""))) / 2 + 1


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks that fit into a broadcast."""
    rows = items.select("item_id", "text")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(_how_many(F.col("text"))), F.lit(0.0)).alias("terms")).first()
    blocks = max(-(-size.n // ITEMS), int(-(-size.terms // ITEM_TERMS)))
    for block in range(blocks):
        found = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # ITEMS rows and ITEM_TERMS terms on average
        if found:
            yield Items.of(sorted(((r.item_id, r.text) for r in found), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))


def _found(spark: SparkSession, docs: DataFrame, items: Items, top: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for one block of items."""
    sent = spark.sparkContext.broadcast(items.number)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    postings = keep(rows.mapInArrow(_postings(sent), "doc_id long, n long, terms binary, tfs binary"))
    sums = postings.mapInArrow(_tally(len(items.number)), "term long, many long").groupBy("term").agg(F.sum("many").alias("many")).toArrow()  # a row for each term of the block
    count = dict(zip(sums["term"].to_pylist(), sums["many"].to_pylist()))
    n_docs, n_terms = count.get(-1, 0), count.get(-2, 0)
    df = np.array([count.get(t, 0) for t in range(len(items.number))], np.int64)
    items.weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    items.number = {}
    best = postings.mapInArrow(_search(spark.sparkContext.broadcast(items), n_docs, max(n_terms, 1), top), FOUND)
    best = best.repartitionByRange("item", "doc_id").mapInArrow(_select(top), FOUND)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> item_id, rank, doc_id, score of each item's best documents."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items):
        out = out.unionByName(_found(spark, docs, block, top))
    return out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, nd),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM p WHERE score > 0 QUALIFY rank <= {TOP}"""
