"""SimHash near-duplicates: fingerprints within a Hamming radius, found by pigeonring filtering.

Fingerprints of 64 bits are cut into radius + 1 segments that stand in a ring. If two differ in at most
`radius` bits, then some segment starts a chain of which every first l segments together differ in at
most floor(l * radius / (radius + 1)) bits: none in the first, at most one in the first two, two in
three, and so on. So a candidate pair agrees in one segment and in one half of the segment after it;
both make the key under which different fingerprints meet. A pair must then pass the whole chain, and
last the full Hamming check.

Equal fingerprints are one row from the start. A key with more than `HOT` fingerprints is cut: two of them
within the radius agree in one of radius + 1 parts of the bits that the key leaves open, so such parts
make longer keys, which go to other tasks; this is done `LEVELS` times at most, and what is left in a key
is cut likewise where it is compared. Within a key, fingerprints that a path of links already joins are not
linked again, and those that are joined leave as a tree in which none has more than three neighbours, so a
key of m fingerprints gives at most m - 1 edges, and none is a hub. Components come from min-label
propagation with pointer jumping, cut by checkpoint() in the shared folder; joins by label are spread, as is the
join of rows with their fingerprint's class.

Cases: null and empty texts, and texts of white space only, have no words and fingerprint zero, which
links like any other; rows may repeat or share doc_id (null ids are kept and never smallest, unless there
is no other); extra columns are carried or ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, hot_join, keep, keyed_rows, schema_with, spread_join, table, unkeyed

BITS = 64
SHINGLE = 4
RADIUS = 4
#: Fingerprints of one key whose pairs are compared at once; more are cut again.
BLOCK = 1024
#: Fingerprints of one key that stay together, and how often keys are cut at most.
HOT, LEVELS = 4096, 3
#: Edges of a component search that are worth a task of their own.
TASK_EDGES = 1 << 16
#: Edges that a task contracts at once.
CONTRACTED = 1 << 18

_U = np.uint64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority vote of the bits of all shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(joined[i:j], 42) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), ">u8", len(words) - k + 1)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *carry: str, shingle: int = SHINGLE) -> DataFrame:
    """docs(carry, text) -> (carry, print), a row for each."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            prints = np.fromiter((fingerprint(t, shingle) for t in texts), _U, len(texts))
            yield extended(batch, 1, print=pa.array(prints.view(np.int64)))

    return docs.select(*carry, "text").mapInArrow(run, schema_with(docs.select(*carry), "print long"))


def segments(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, bits) of the ring's segments."""
    m = radius + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ring_masks(radius: int = RADIUS, chain: int = 2) -> list[int]:
    """Sets of bits of which two fingerprints within the radius agree in one.

    Of a chain of `chain` segments that keeps within its budgets the first agrees, and of the others' halves
    as many as the chain's budget leaves.
    """
    ring, out = segments(radius), []
    mask = lambda first, size: ((1 << size) - 1) << first
    for i, own in enumerate(ring):
        halves = []
        for k in range(1, chain):
            first, size = ring[(i + k) % len(ring)]
            halves += [mask(first, size // 2), mask(first + size // 2, size - size // 2)]
        equal = max(0, len(halves) - chain * radius // (radius + 1))
        out += [mask(*own) | sum(x) for x in combinations(halves, equal)]
    return out


def cut_mask(mask: int, radius: int = RADIUS) -> list[int]:
    """The bits of a mask with each of radius + 1 parts of the others: two fingerprints within the radius that agree in the mask agree in one."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in rest[i :: radius + 1]) for i in range(radius + 1)]


def _signed(m: int) -> Column:
    return F.lit(m - (1 << 64) if m >> 63 else m)


def _hot_keys_cut(prints: DataFrame, radius: int, chain: int) -> DataFrame:
    """prints(print) -> (print, key): all keys, of which frequent ones are replaced by longer ones."""
    masks, step = ring_masks(radius, chain), radius + 1
    key = lambda t, mask: F.xxhash64(t, F.col("print").bitwiseAND(mask))
    keyed = prints.select("print", F.posexplode(F.array(*map(_signed, masks))).alias("t", "mask")).select("print", "t", key(F.col("t"), F.col("mask")).alias("key"))
    for level in range(1, LEVELS + 1):
        hot = keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
        if not hot.head(1):
            break
        longer = [cut_mask(m, radius) for m in masks]
        parts = F.element_at(F.array(*[F.array(*map(_signed, x)) for x in longer]), F.col("t") + 1)
        cut_ = keyed.join(hot, "key").select("print", "t", F.posexplode(parts).alias("i", "mask"))
        cut_ = cut_.withColumn("t", F.col("t") * step + F.col("i")).select("print", "t", key(F.col("t") + F.lit(level * 1_000_000), F.col("mask")).alias("key"))
        keyed = keyed.join(hot, "key", "left_anti").select("print", F.lit(-1).alias("t"), "key").unionByName(cut_)
        masks = [m for x in longer for m in x]
    return keyed.select("print", "key")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chained(x: np.ndarray, radius: int) -> np.ndarray:
    """Whether differences x pass the ring's filter: from some segment on, every chain stays within its budget."""
    ring = segments(radius)
    m = len(ring)
    differ = [_popcount((x >> _U(a)) & _U((1 << n) - 1)).astype(np.int16) for a, n in ring]
    passed = np.zeros(x.shape, bool)
    for i in range(m):
        ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int16)
        for step in range(m):
            total = total + differ[(i + step) % m]
            ok &= total <= (step + 1) * radius // m
        passed |= ok
    return passed


class _Sets:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def near_differences(x: np.ndarray, radius: int) -> np.ndarray:
    """Indices of the differences that pass the ring's filter and then the full check."""
    few = np.flatnonzero(chained(x, radius)) if len(x) else np.zeros(0, np.int64)
    return few[_popcount(x[few]) <= radius]


def _link(prints: np.ndarray, rows: np.ndarray, radius: int, sets: _Sets, links: list) -> None:
    """Spanning links among prints[rows]; many rows are cut by the bits in which they still differ."""
    if len(rows) > BLOCK:
        varying = int(np.bitwise_or.reduce(prints[rows] ^ prints[rows[0]]))
        places = [b for b in range(BITS) if varying >> b & 1]
        if len(places) > 2 * (radius + 1):
            for i in range(radius + 1):  # one part of these bits agrees
                mask = sum(1 << b for b in places[i :: radius + 1])
                value = prints[rows] & _U(mask)
                order = np.argsort(value, kind="stable")
                for group in np.split(rows[order], np.flatnonzero(np.diff(value[order])) + 1):
                    if len(group) > 1:
                        _link(prints, group, radius, sets, links)
            return
    for i in range(0, len(rows), BLOCK):
        for j in range(i, len(rows), BLOCK):
            p, q = np.meshgrid(rows[i : i + BLOCK], rows[j : j + BLOCK], indexing="ij")
            p, q = p.ravel(), q.ravel()
            if i == j:
                p, q = p[p < q], q[p < q]
            for k in near_differences(prints[p] ^ prints[q], radius):
                if sets.join(int(p[k]), int(q[k])):
                    links.append((int(p[k]), int(q[k])))


def spanning_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of rows, sorted by key, that join all rows of a key that links join.

    Rows of keys with few rows are compared with the row 1, 2, ... further on, all keys at once.
    """
    sets, links = _Sets(len(keys)), []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    sizes = np.diff(cuts)
    for i in np.flatnonzero(sizes > BLOCK):
        _link(prints, np.arange(cuts[i], cuts[i + 1]), radius, sets, links)
    left = np.repeat(np.where(sizes > BLOCK, 0, sizes), sizes) - (np.arange(len(keys)) - np.repeat(cuts[:-1], sizes))
    rows, step = np.flatnonzero(left > 1), 1
    while len(rows):
        for k in near_differences(prints[rows] ^ prints[rows + step], radius):
            if sets.join(int(rows[k]), int(rows[k]) + step):
                links.append((int(rows[k]), int(rows[k]) + step))
        step += 1
        rows = rows[left[rows] > step]
    return links


def tree_edges(pairs: np.ndarray, n: int) -> np.ndarray:
    """Pairs of rows below n -> pairs that join the same rows, in which no row has more than three neighbours."""
    sets = _Sets(n)
    for a, b in pairs.tolist():
        sets.join(a, b)
    rows = np.unique(pairs)
    roots = np.array([sets.root(i) for i in rows.tolist()], np.int64)
    order = np.argsort(roots, kind="stable")
    rows, roots = rows[order], roots[order]
    start = np.searchsorted(roots, roots)
    place = np.arange(len(rows)) - start
    below = np.flatnonzero(place)
    return np.column_stack([rows[start[below] + (place[below] - 1) // 2], rows[below]])


def _keyed(radius: int):
    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = pdf["print"].to_numpy()
        pairs = np.array(spanning_links(pdf["key"].to_numpy(), prints.view(_U), radius), np.int64).reshape(-1, 2)
        edges = tree_edges(pairs, len(pdf))
        return pd.DataFrame({"a": prints[edges[:, 0]], "b": prints[edges[:, 1]]})

    def run(batches):
        """Rows come sorted by key; a key's rows may go over batches."""
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf["key"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last or rest and rest[0]["key"].iat[0] != keys[0]:
                yield found(pd.concat([*rest, pdf.iloc[:last]], ignore_index=True))
                rest = []
            rest.append(pdf.iloc[last:])
        if rest:
            yield found(pd.concat(rest, ignore_index=True))

    return run


def links(prints: DataFrame, radius: int = RADIUS, chain: int = 2) -> DataFrame:
    """Different prints(print) -> edges (a, b); prints are joined by a path of edges if they are by pairs within the radius, and only then.

    A longer chain makes longer keys, of which there are more. However many prints there are, frequent keys are cut.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _hot_keys_cut(prints, radius, chain).repartition(n, "key").sortWithinPartitions("key").mapInPandas(_keyed(radius), "a long, b long").distinct()


def _contracted(batches):
    """Edges (a, b) -> edges that join the same nodes, for every `CONTRACTED` of them a tree by node number in which none has more than three neighbours."""

    def trees(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.column_stack([np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (0, 1)])
        nodes, which = np.unique(ends, return_inverse=True)
        found = nodes[tree_edges(which.reshape(-1, 2), len(nodes))] if len(nodes) else ends
        return pa.RecordBatch.from_pydict({"a": found[:, 0], "b": found[:, 1]})

    parts: list[pa.RecordBatch] = []
    for batch in batches:
        parts.append(batch)
        if sum(p.num_rows for p in parts) >= CONTRACTED:
            yield trees(parts)
            parts = []
    if parts:
        yield trees(parts)


def _reached(batches):
    """All edges (a, b), `CONTRACTED` at most -> (node, label): the smallest node that can be reached."""
    parts = list(batches)
    ends = np.column_stack([np.concatenate([np.zeros(0, np.int64), *(p.column(i).to_numpy() for p in parts)]) for i in (0, 1)])
    nodes, which = np.unique(ends, return_inverse=True)
    sets = _Sets(len(nodes))
    for a, b in which.reshape(-1, 2).tolist():
        sets.join(a, b)
    # nodes are in order, and a set's root is its first
    yield pa.RecordBatch.from_pydict({"node": nodes, "label": nodes[[sets.root(i) for i in range(len(nodes))]] if len(nodes) else nodes})


def components(edges: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """edges(a, b), longs -> (node, label): the smallest node that can be reached, for every node with an edge.

    Tasks first replace their edges by trees, so that paths are short where they can. If no more are left than a task contracts at
    once, it finds all labels, without rounds, each of whose shuffles takes the driver's memory too. Else every round a node takes the
    smallest label among its own and its neighbours', and then its label's label; at most about log(longest path) rounds. Many
    nodes may have one label, so the join by label is spread. Few edges are handled by few tasks, as every round shuffles anew.
    """
    own = keep(edges.select("a", "b").mapInArrow(_contracted, "a long, b long"))
    many = own.count()
    if many <= CONTRACTED:
        labels = cut(own.coalesce(1).mapInArrow(_reached, "node long, label long"))
        own.unpersist()
        return labels.select(F.col("node").alias(node), F.col("label").alias(label))
    tasks = min(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // TASK_EDGES + 1)
    few = lambda df: df.coalesce(tasks)
    # each edge both ways
    ways = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = keep(few(own).mapInArrow(_contracted, "a long, b long").select(ways).distinct())
    labels = cut(few(few(both).groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("l")).select(F.col("a").alias("v"), "l")))
    while True:
        near = few(few(both).join(labels.withColumnRenamed("v", "b"), "b")).groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        stepped = keep(few(labels.join(few(near), "v").select("v", F.col("l").alias("was"), F.least("l", "m").alias("l"))))
        further = stepped.select(F.col("v").alias("l"), F.col("l").alias("ll")).join(few(stepped.select("l").distinct()), "l", "left_semi").where("ll <> l")
        labels = cut(few(spread_join(stepped, few(further), "l", "v", "left").select("v", "was", F.least("l", F.coalesce("ll", "l")).alias("l"))))
        stepped.unpersist()
        if not labels.where("l <> was").head(1):
            both.unpersist()
            own.unpersist()
            return labels.select(F.col("v").alias(node), F.col("l").alias(label))
        labels = labels.select("v", "l")


def near_duplicates(docs: DataFrame, *carry: str, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, carry, text) -> (doc_id, carry, print, component, component_id).

    component names the group; component_id is the smallest doc_id in it.
    """
    rows = keep(fingerprints(docs, "doc_id", *carry, shingle=shingle))
    prints = keep(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    joined = components(links(prints, radius), "print", "component")
    members = prints.join(joined, "print", "left").withColumn("component", F.coalesce("component", "print"))
    smallest = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = spread_join(members, smallest, "component", "print").select("print", "component", "component_id")
    return hot_join(rows, classes, "print", "doc_id").select("doc_id", *carry, "print", "component", "component_id")


def first_of_each(found: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of found(doc_id, doc_key, tie, component) each component's row with the smallest id (null ids last, then by key), out of rows, in the columns of docs."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key", "tie")).alias("s")
    stay = found.groupBy("component").agg(least).select("s.doc_key", "s.tie")
    return unkeyed(rows.join(stay, ["doc_key", "tie"], "left_semi").dropDuplicates(["doc_key", "tie"]), docs)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without near duplicates: of each group the one with the smallest id stays."""
    rows = keyed_rows(docs)
    found = near_duplicates(rows.withColumn("doc_id", F.col("row.doc_id")), "doc_key", "tie", shingle=shingle, radius=radius)
    return first_of_each(found, docs, rows)


def op10_simhash_near(spark, sf_dir: str) -> DataFrame:
    done = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(texts: dict[int, str | None], shingle: int = SHINGLE, radius: int = RADIUS) -> dict[int, tuple[str, int]]:
    """The same by comparing all pairs of a few small texts."""
    prints = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
        prints[k] = sum(1 << b for b in range(BITS) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    ids = sorted(texts)
    label = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and bin(prints[i] ^ prints[j]).count("1") <= radius:
                    label[i], changed = label[j], True
    return {k: (f"{prints[k]:016x}", label[k]) for k in ids}
