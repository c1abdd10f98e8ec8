"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of lower-cased character n-grams, hashed into 2^20 buckets, anywhere in the whole
text. From a bounded sample of labelled documents come each bucket's document counts among toxic and other
texts and their log ratio r; a logistic regression is then fitted on features scaled by r. `PRIOR` documents
of the sample's own mix are added to every count, and r is shrunk by z^2 / (z^2 + `SHRINK`), z being r over its
standard error: what is poorly supported counts for little, but every n-gram of the sample keeps a weight.

The sample's n-grams are extracted once and stored as a list of buckets for each document. The regression is
fitted by the sample's `PARTS` at once: in each round every part starts from the weights so far and fits them to
its own documents, a mini-batch after the other, and the parts' weights are averaged. A part holds its lists, 4 bytes
a bucket, and the arrays of one mini-batch. Only weights, as many as there are buckets, come to the driver.

Cases: a null text is an empty one and scores by the intercept; repeated rows score alike; without a
labelled document of both kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, extended, held_out, keep, lent, schema_with, shuffles_removed, table, text_blocks, unpack
from .labelled import Adam, fit_line, labelled_sample, sigmoid

FOLDS, FOLD = 5, 0
#: Most labelled documents that the classifier is fitted on.
SAMPLE = 4_000
ORDERS = (4, 5, 6)
BITS = 20
PRIOR, SHRINK = 4.0, 16.0
#: Parts of the sample, documents of a mini-batch, rounds of averaging, and how often a round goes over a part's documents.
PARTS, BATCH, ROUNDS, EPOCHS = 8, 64, 3, 7


@dataclass
class Model:
    weights: np.ndarray  # of each bucket
    bias: float


def _grams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(document, bucket) of every n-gram of each order, and how many documents."""
    found = [(t or "").lower() for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    chars = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
    out, n = [], len(chars)
    # the multiplier's powers make the hash depend on order; the order of the n-gram goes in first
    state = np.zeros(n, np.uint32)
    for k in range(1, max(ORDERS) + 1):
        if n < k:
            break
        state = (state[: n - k + 1] + chars[k - 1 :] + np.uint32(k)) * np.uint32(0x9E3779B1)
        state ^= state >> np.uint32(15)
        if k in ORDERS:
            inside = doc[: n - k + 1] == doc[k - 1 :]
            bucket = (state * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            out.append((doc[: n - k + 1][inside], bucket[inside]))
    return out, len(found)


def _present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, bucket), each pair once and in order, and how many documents."""
    grams, n = _grams(texts)
    keys = np.sort(np.concatenate([np.zeros(0, np.int64), *(d.astype(np.int64) << BITS | b for d, b in grams)]))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    keys = keys[first]
    return keys >> BITS, keys & ((1 << BITS) - 1), n


def _lists(batches):
    """(y, text) -> (y, buckets), each document's different buckets: their sorted differences, compressed."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        labels = batch.column("y").to_numpy()
        for first, texts in text_blocks(batch.column("text"), BLOCK_BYTES // 2):
            doc, bucket, n = _present(texts)
            own = np.split(bucket.astype("<i4"), np.searchsorted(doc, np.arange(1, n)))
            yield pa.RecordBatch.from_pydict({"y": pa.array(labels[first : first + n], pa.int32()), "buckets": pa.array([press(np.diff(x, prepend=np.int32(0)).tobytes()) for x in own], pa.binary())})


def _stored(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.cumsum(np.frombuffer(unpack(x), "<i4"), dtype=np.int32) for x in batch.column("buckets").to_pylist()]


def _counts(batches):
    """Documents with each bucket, by label, over a task's documents."""
    tally = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for y, own in zip(batch.column("y").to_pylist(), _stored(batch)):
            tally[y, own] += 1
    at = np.flatnonzero(tally.any(axis=0))
    yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "other": tally[0, at], "toxic": tally[1, at]})


def log_ratios(other: np.ndarray, toxic: np.ndarray, n_other: int, n_toxic: int) -> np.ndarray:
    """Shrunk log-count ratios of features in so many of n_other and of n_toxic documents."""
    share = n_toxic / (n_other + n_toxic)
    a, b = other + PRIOR * (1 - share), toxic + PRIOR * share
    r = np.log(b / n_toxic) - np.log(a / n_other)
    support = r * r / (1 / a + 1 / b)
    return r * support / (support + SHRINK)


def _fit_part(ratio, start, penalty: float = 1e-3):
    """Mini-batches of a logistic regression on presence scaled by r, over a task's documents: the weights of the buckets seen, and the bias."""

    def run(batches):
        lists, labels = [], []
        for batch in batches:
            lists += _stored(batch)
            labels += batch.column("y").to_pylist()
        if not lists:
            return
        r, w, adam = ratio.value, start.value.copy(), Adam((1 << BITS) + 1, 0.05)
        order = np.random.default_rng(5).permutation(len(lists))
        # all of nearly one size, so that a small last one doesn't count for more than it holds
        cuts = np.array_split(order, -(-len(order) // BATCH))
        for _ in range(EPOCHS):
            for own in cuts:
                feature = np.concatenate([lists[i] for i in own])
                doc = np.repeat(np.arange(len(own)), [len(lists[i]) for i in own])
                scale = r[feature]
                margin = np.bincount(doc, scale * w[feature], len(own)) + w[-1]
                d = (sigmoid(margin) - np.array([labels[i] for i in own])) / len(own)
                g = penalty * w
                g[:-1] += np.bincount(feature, scale * d[doc], 1 << BITS)
                g[-1] = d.sum()
                w = adam.step(w, g)
        seen = np.zeros(1 << BITS, bool)
        for x in lists:
            seen[x] = True
        at = np.append(np.flatnonzero(seen), 1 << BITS)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "weight": w[at], "docs": np.full(len(at), float(len(lists)))})

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, fold: int = FOLD, limit: int = SAMPLE) -> Model | None:
    """Fit on the labelled documents outside the held-out fold; None where only one label is there."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, folds, fold, limit).withColumn("at", F.xxhash64("text"))
    # in a fixed order, so that a part that runs again fits alike
    sample = sample.repartition(PARTS, "at").sortWithinPartitions("at", "y")
    stored = keep(sample.select("y", "text").mapInArrow(_lists, "y int, buckets binary"))
    try:
        with shuffles_removed(spark):
            return _fitted(stored)
    finally:
        stored.unpersist()
        pa.default_memory_pool().release_unused()


def _fitted(stored: DataFrame) -> Model | None:
    """stored(y, buckets) -> the model; what a round shuffles and broadcasts is gone before the next."""
    spark = stored.sparkSession
    n = {r.y: r.n for r in stored.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    counts = stored.mapInArrow(_counts, "bucket int, other int, toxic int").groupBy("bucket").agg(*[F.sum(c).cast("int").alias(c) for c in ("other", "toxic")])
    ratio, weights = np.zeros(1 << BITS), np.zeros((1 << BITS) + 1)
    found = counts.toArrow()  # at most 2^BITS rows
    bucket, a, b = (found[c].to_numpy() for c in ("bucket", "other", "toxic"))
    ratio[bucket] = log_ratios(a, b, n[0], n[1])
    del found, bucket, a, b
    weights[-1] = np.log(n[1] / n[0])
    with lent(spark, ratio) as given:
        for _ in range(ROUNDS):
            with lent(spark, weights) as start:
                fitted = stored.mapInArrow(_fit_part(given, start), "bucket int, weight double, docs double")
                mean = fitted.groupBy("bucket").agg((F.sum(F.col("weight") * F.col("docs")) / F.sum("docs")).alias("weight")).toArrow()
            weights = weights.copy()
            weights[mean["bucket"].to_numpy()] = mean["weight"].to_numpy()
            del mean
    model = Model((weights[:-1] * ratio).astype(np.float32), float(weights[-1]))
    with lent(spark, model.weights) as given:
        told = stored.mapInArrow(_stored_margins(given, model.bias), "y int, score double").toArrow()
    slope, shift = fit_line(told["score"].to_numpy(), told["y"].to_numpy().astype(float), 1500)
    return Model(model.weights * np.float32(slope), model.bias * slope + shift)


def _stored_margins(weights, bias: float):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "score": pa.array([float(weights.value[x].sum(dtype=float)) + bias for x in _stored(batch)], pa.float64())})

    return run


def _margins(weights, bias: float, of=lambda x: x):
    def run(batches):
        for batch in batches:
            parts = [np.zeros(0)]
            for _, texts in text_blocks(batch.column(batch.num_columns - 1), BLOCK_BYTES // 2):
                doc, bucket, n = _present(texts)
                parts.append(of(np.bincount(doc, weights.value[bucket].astype(float), n)[:n] + bias))
            yield extended(batch, 1, score=pa.array(np.concatenate(parts)))

    return run


def score(docs: DataFrame, model: Model | None, *carry: str) -> DataFrame:
    """docs(carry, text) -> the carried columns and `score`, the probability that the whole text is toxic."""
    if model is None:
        return docs.select(*carry, F.lit(0.0).alias("score"))
    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias("text"))
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    return rows.mapInArrow(_margins(weights, model.bias, sigmoid), schema_with(docs.select(*carry), "score double"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
