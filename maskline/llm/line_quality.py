"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own shape (length, shares of character classes,
repeated words, a line seen before) and that of the lines before and after it; neighbouring labels are
tied by transition weights. Forward-backward gives each line's marginal; marginals weighted by line
length add up to a document's quality, which a logistic curve, fitted on the sample, turns into a score.

Labels are for documents, so training starts with the document's label on every line and then lets bad
documents keep only those lines bad that the field itself finds bad (the worst line always).

Cases: a null text is an empty one; an empty text is one empty line; repeated rows score alike; without
labelled documents of both kinds every score is the share of good ones (1 with none); extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import raw_bytes, word_hashes, words
from .common import BLOCK_BYTES, extended, held_out, schema_with, table, text_blocks
from .labelled import Adam, fit_line, labelled_sample, sigmoid

FOLDS, FOLD = 3, 1
#: Most labelled documents that the field is fitted on.
SAMPLE = 3_000
SHAPE = 16


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the features of a bad line
    moves: np.ndarray  # 2 x 2 transition weights; 1 is bad
    slope: float
    shift: float


def _classes() -> np.ndarray:
    """Class of each byte: upper, lower, digit, space, bar, symbol, other mark, beyond ASCII."""
    out = np.full(256, 6, np.int64)
    out[65:91], out[97:123], out[48:58] = 0, 1, 2
    out[list(b" \t\r\x0b\x0c\n")] = 3
    out[ord("|")] = 4
    out[list(b"#$%&*@^~+=<>_\\/!")] = 5
    out[128:] = 7
    return out


def line_shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bytes, features) of every line."""
    raw, ends = raw_bytes(texts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    breaks = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([starts, breaks + 1]))
    doc = np.sort(np.concatenate([np.arange(len(ends)), np.searchsorted(ends, breaks, side="right")]))
    last = np.ones(len(begin), bool)
    last[:-1] = doc[1:] != doc[:-1]
    end = np.append(begin[1:], len(raw))[: len(begin)] - ~last
    size = end - begin
    full = np.maximum(size, 1)

    kind = _classes()[raw]
    shares = []
    for k in range(8):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        shares.append((total[end] - total[begin]) / full)
    s, e, _ = words(raw, ends)
    line = np.searchsorted(begin, s, side="right") - 1
    n_words = np.bincount(line, minlength=len(begin))
    h = word_hashes(raw, s, e)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[same], minlength=len(begin)) / np.maximum(n_words, 1)
    key = (h & np.uint64(0xFFFFFFFF)).astype(np.int64) << 31 | line
    first = np.unique(key) & ((1 << 31) - 1)
    distinct = np.bincount(first, minlength=len(begin)) / np.maximum(n_words, 1)
    # words with a mark at their end, and capitals at their start
    tail = kind[e - 1] if len(e) else kind[:0]
    marked = np.bincount(line[(tail == 5) | (tail == 6)], minlength=len(begin)) / np.maximum(n_words, 1)
    # the line's words seen on an earlier line of the same document, all of them
    sums = np.zeros(len(begin), np.uint64)
    np.add.at(sums, line, h)
    whole = sums ^ (doc.astype(np.uint64) << np.uint64(40))
    _, where = np.unique(whole, return_index=True)
    again = np.ones(len(begin))
    again[where] = 0
    again[n_words == 0] = 0
    shape = np.column_stack([np.log1p(size), np.log1p(n_words), *shares, size / np.maximum(n_words, 1) / 10, repeats, distinct, marked, again, (n_words == 0) * 1.0])
    return doc, size, shape


def _with_neighbours(shape: np.ndarray, doc: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(shape), np.zeros_like(shape)
    if len(doc):
        joined = (doc[1:] == doc[:-1])[:, None]
        before[1:], after[:-1] = shape[:-1] * joined, shape[1:] * joined
    return np.hstack([shape, before, after, np.ones((len(shape), 1))])


class Chains:
    """Lines of several documents, stepped through side by side: step t takes line t of all that have one."""

    def __init__(self, doc: np.ndarray):
        sizes = np.bincount(doc) if len(doc) else np.zeros(0, int)
        sizes = sizes[sizes > 0]
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        ordered = sizes[order]
        self.steps = [starts[order[: np.searchsorted(-ordered, -t, side="left")]] + t for t in range(int(ordered[0]) if len(ordered) else 0)]

    def marginals(self, bad: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(line is bad), and the expected number of each transition, by forward-backward."""
        unary = np.column_stack([np.zeros(len(bad)), bad])
        f, b = unary.copy(), np.zeros_like(unary)
        for p, q in zip(self.steps, self.steps[1:]):
            x = f[p[: len(q)]][:, :, None] + moves
            f[q] += np.logaddexp(x[:, 0], x[:, 1])
        pairs = np.zeros((2, 2))
        for p, q in zip(self.steps[-2::-1], self.steps[:0:-1]):
            p = p[: len(q)]
            x = moves + (unary[q] + b[q])[:, None, :]
            b[p] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        z = np.logaddexp(f[:, 0] + b[:, 0], f[:, 1] + b[:, 1])
        for p, q in zip(self.steps, self.steps[1:]):
            p = p[: len(q)]
            pairs += np.exp(f[p][:, :, None] + moves + (unary[q] + b[q])[:, None, :] - z[p][:, None, None]).sum(axis=0)
        return np.exp(f[:, 1] + b[:, 1] - z), pairs


def _gold_pairs(chains: Chains, y: np.ndarray) -> np.ndarray:
    out = np.zeros((2, 2))
    for p, q in zip(chains.steps, chains.steps[1:]):
        p = p[: len(q)]
        for i in (0, 1):
            for j in (0, 1):
                out[i, j] += ((1 - i + (2 * i - 1) * y[p]) * (1 - j + (2 * j - 1) * y[q])).sum()
    return out


def _fit(x: np.ndarray, chains: Chains, y: np.ndarray, w: np.ndarray, moves: np.ndarray, rounds: int, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent on the field's likelihood; y: expected labels of the lines."""
    gold, n, k = _gold_pairs(chains, y), len(y), len(w)
    theta, adam = np.concatenate([w, moves.ravel()]), Adam(k + 4, 0.05)
    for _ in range(rounds):
        bad, pairs = chains.marginals(x @ theta[:k], theta[k:].reshape(2, 2))
        g = np.concatenate([x.T @ (bad - y), (pairs - gold).ravel()]) / n + penalty * theta
        theta = adam.step(theta, g)
    return theta[:k], theta[k:].reshape(2, 2)


def _document(doc: np.ndarray, size: np.ndarray, bad: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the marginals, as log-odds of a good document."""
    weight = size + 1.0
    mean = np.bincount(doc, weight * bad, n) / np.maximum(np.bincount(doc, weight, n), 1e-9)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(1 - mean) - np.log(mean)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, fold: int = FOLD, limit: int = SAMPLE) -> Model | float:
    """Fit on the labelled documents outside the held-out fold; the share of good ones where only one label is there."""

    def shapes(batches):
        for batch in batches:
            for first, texts in text_blocks(batch.column("text"), BLOCK_BYTES // 2):
                doc, size, shape = line_shapes(texts)
                cuts = np.searchsorted(doc, np.arange(1, len(texts)))
                rows = np.column_stack([size, shape]).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"y": batch.column("y").slice(first, len(texts)).cast(pa.int32()), "f": pa.array([r.ravel() for r in np.split(rows, cuts)], pa.list_(pa.float32()))})

    rows = labelled_sample(docs, labels, label, folds, fold, limit).repartition(8).mapInArrow(shapes, "y int, f array<float>").toArrow()
    quality = rows["y"].to_numpy()
    if len(quality) == 0 or quality.min() == quality.max():
        return float(quality.mean()) if len(quality) else 1.0
    parts = [np.asarray(x.values, np.float64).reshape(-1, SHAPE + 1) for c in rows["f"].chunks for x in c]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    table_ = np.concatenate(parts)
    size, shape = table_[:, 0], table_[:, 1:]
    mean, spread = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    x = _with_neighbours((shape - mean) / spread, doc)
    chains = Chains(doc)
    bad_document = (quality[doc] == 0).astype(float)
    w, moves = _fit(x, chains, bad_document, np.zeros(x.shape[1]), np.zeros((2, 2)), 120)
    for _ in range(2):
        bad, _ = chains.marginals(x @ w, moves)
        worst = np.zeros(len(parts))
        np.maximum.at(worst, doc, bad)
        y = bad_document * np.where(bad >= worst[doc], 1.0, (bad > 0.5) * 1.0)
        w, moves = _fit(x, chains, y, w, moves, 60)
    bad, _ = chains.marginals(x @ w, moves)
    slope, shift = fit_line(_document(doc, size, bad, len(parts)), (quality == 1).astype(float), 1500)
    return Model(mean, spread, w, moves, slope, shift)


def document_scores(model: Model, texts: pa.Array) -> np.ndarray:
    doc, size, shape = line_shapes(texts)
    bad, _ = Chains(doc).marginals(_with_neighbours((shape - model.mean) / model.spread, doc) @ model.weights, model.moves)
    return sigmoid(model.slope * _document(doc, size, bad, len(texts)) + model.shift)


def score(docs: DataFrame, model: Model | float, *carry: str) -> DataFrame:
    """The carried columns and `score`, the probability that the document is good."""
    if not isinstance(model, Model):
        return docs.select(*carry, F.lit(model).alias("score"))

    def run(batches):
        for batch in batches:
            parts = [np.zeros(0)]
            for _, texts in text_blocks(batch.column(batch.num_columns - 1), BLOCK_BYTES // 2):
                parts.append(document_scores(model, texts))
            yield extended(batch, 1, score=pa.array(np.concatenate(parts)))

    kept = docs.select(*carry)
    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema_with(kept, "score double"))


def op6_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
