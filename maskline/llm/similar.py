"""SimHash near-duplicates at a similarity: five-word shingles with a Jaccard similarity of 0.8 or more, exactly verified.

The same operator as `simhash_near.py`, and then a wider radius. First fingerprints meet by pigeonring filtering, as
there: those within `NEAR` bits are joined by a tree, whose edges, with one from each fingerprint's first text to
its others, are the first pairs to be compared.

Two texts of similarity 0.8 differ in ten bits of 64 on average, and in more than `RADIUS` with a chance of about
1e-7. A ring for that radius has segments of two or three bits, which make no keys: every two texts would meet. So the
pairs that are further apart than `NEAR` bits meet by MinHash keys, `BANDS` keys of `ROWS` minima each, of which a pair of
similarity s shares none with a chance of (1 - s ** ROWS) ** BANDS, 8e-6 at 0.8. All pairs that meet must pass the
ring's chains, then the full Hamming check, and last the shingles themselves are compared; only then they are links.

Texts with equal shingles are one row from the start, named by a number of its own. Pairs that links already join
need no comparison: those of the ring and, in a sample of the keys, each row with one before it come first, then all keys.
No key is capped or left out, and keys are dealt by ranges of (key, row), so that a frequent one goes to many tasks.

What is then left are keys with rows that no links join. Their pairs are not made: a template's thousand
texts of similarity 0.7 would be a million. Instead the rows of all such keys are joined by prefixes: shingles stand in
one order, rare ones first, and two sets of similarity 0.8 have their first common shingle among the first fifth of
both, and early enough in both for the rest to suffice. A template's common shingles come after those that tell
its texts apart, so texts below 0.8 rarely meet. This loses no pair, whatever the order; how frequent a shingle is
comes from counts in `ORDER_BITS` buckets. Rows of a shingle that have its most frequent label, which links
have joined already, are not paired with each other.

Cases: words are lower-cased in A-Z; a text of under five words is one shingle, its words; null and empty
texts, and texts of white space only, have none and are one group; rows may repeat or share doc_id (null
ids are never smallest); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, hot_join, keep, keyed_rows, pack_texts, schema_with, shuffles_removed, text_blocks, unpack
from .decontaminate import shingle_hashes, text_shingles
from .simhash_near import RADIUS as NEAR
from .simhash_near import components, first_of_each, links, near_differences

SHINGLE = 5
#: A pair is similar from 4/5 on.
SHARE, OF = 4, 5
#: Bits in which fingerprints of a similar pair may differ.
RADIUS = 26
BANDS = 64
ROWS = 8
#: One key of so many is looked at in the first round.
SAMPLE = 8
#: Buckets in which shingles are counted, as a power of two.
ORDER_BITS = 20
#: Texts whose shingles a task remembers while it compares pairs.
REMEMBERED = 64

_U = np.uint64


def _families() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def band_keys(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Shingle hashes h of texts that begin at these places, none empty -> BANDS keys a text."""
    a, b = _families()
    x = (h >> _U(32)).astype(np.uint32)
    out = np.empty((len(begin), BANDS), _U)
    for band in range(BANDS):
        key = np.full(len(begin), band + 1, _U)
        for f in range(band * ROWS, (band + 1) * ROWS):
            key = _mixed(key ^ np.minimum.reduceat(x * a[f] + b[f], begin).astype(_U))
        out[:, band] = key
    return out


def set_print(h: np.ndarray) -> int:
    """SimHash of different shingle hashes: the majority of each bit."""
    votes = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big", signed=True)


def sketches(docs: DataFrame, *carry: str) -> DataFrame:
    """docs(carry, text) -> (carry, same, same_low, n, print, keys): 128 bits that texts with equal shingles share, their number, fingerprint, band keys."""

    def run(batches):
        for batch in batches:
            for first, texts in text_blocks(batch.column(batch.num_columns - 1)):
                doc, h = shingle_hashes(texts, SHINGLE)
                count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
                ends = np.cumsum(count)
                own = [np.unique(h[e - c : e]) for c, e in zip(count.tolist(), ends.tolist())]
                same = np.array([divmod(xxhash.xxh3_128_intdigest(x.tobytes()), 1 << 64) for x in own], _U).view(np.int64).reshape(-1, 2)
                full = np.flatnonzero(count)
                keys = band_keys(h, (ends - count)[full]).view(np.int64).ravel() if len(full) else np.zeros(0, np.int64)
                edges = np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))])
                part = batch.slice(first, len(texts))
                yield extended(part, 1, same=pa.array(same[:, 0]), same_low=pa.array(same[:, 1]), n=pa.array([len(x) for x in own], pa.int64()), print=pa.array([set_print(x) for x in own], pa.int64()), keys=pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys)))

    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema_with(docs.select(*carry), "same long", "same_low long", "n long", "print long", "keys array<long>"))


def _neighbours(batches):
    """Rows (key, row, n) sorted by key and row -> those that share a key, each with one before it; a part's first and last rows may share theirs.

    The i-th row of a key gets the ((i - 1) // 2)-th: all are joined by short paths, and none is in many pairs.
    """

    def out(key, row, n, parent, pick):
        has = parent[pick] >= 0
        before = np.maximum(parent[pick], 0)
        columns = [pa.array(x[pick]) for x in (key, row, n)] + [pa.array(x[before], mask=~has) for x in (row, n)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "row", "n", "before", "n_before"])

    held, done, first = tuple(np.zeros(0, np.int64) for _ in range(3)), 0, True  # the last key's rows, how many are out, whether it is the part's first
    for batch in batches:
        if not batch.num_rows:
            continue
        key, row, n = (np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(held))
        begins = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        sizes = np.diff(np.append(begins, len(key)))
        begin, place = np.repeat(begins, sizes), np.arange(len(key)) - np.repeat(begins, sizes)
        parent = np.where(place > 0, begin + (place - 1) // 2, -1)
        shared = np.repeat(sizes > 1, sizes)
        last = int(begins[-1])
        if first and last:
            shared[: sizes[0]] = True
        shared[:done] = False
        pick = np.flatnonzero(shared)
        if len(pick):
            yield out(key, row, n, parent, pick)
        first = first and not last
        done = len(key) - last if sizes[-1] > 1 else 0
        held = tuple(x[last:] for x in (key, row, n))
    if len(held[0]) > done:
        yield out(*held, np.full(len(held[0]), -1), np.arange(done, len(held[0])))


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) and texts(row, print, packed) -> (a, b, linked): by ring and Hamming distance, then by the shingles themselves."""

    def run(batches):
        seen: dict[int, set[bytes]] = {}

        def of(row: int, packed: bytes) -> set[bytes]:
            if row not in seen:
                if len(seen) >= REMEMBERED:
                    del seen[next(iter(seen))]
                seen[row] = text_shingles(unpack(packed).decode("utf-8", "surrogatepass"), SHINGLE)
            return seen[row]

        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            differ = batch.column("differ").to_numpy().view(_U)
            for i in near_differences(differ, RADIUS).tolist():
                a, b, x, y = (batch.column(c)[i].as_py() for c in ("a", "b", "one", "other"))
                p, q = of(a, x), of(b, y)
                both = len(p & q)
                linked[i] = OF * both >= SHARE * (len(p) + len(q) - both)
            yield extended(batch, 3, linked=pa.array(linked))

    left = texts.select(F.col("row").alias("a"), F.col("print").alias("print_a"), F.col("packed").alias("one"))
    right = texts.select(F.col("row").alias("b"), F.col("print").alias("print_b"), F.col("packed").alias("other"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "one", "other", F.col("print_a").bitwiseXOR(F.col("print_b")).alias("differ"))
    return met.mapInArrow(run, "a long, b long, linked boolean")


def _could(one: str, other: str):
    """Whether shingles of these numbers can be similar at all."""
    return F.least(one, other) * OF >= F.greatest(one, other) * SHARE


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h * _U(0x9E3779B97F4A7C15)) >> _U(64 - ORDER_BITS)


def _own_hashes(packed: pa.Array):
    """Different shingle hashes of each text."""
    for x in packed.to_pylist():
        yield np.unique(shingle_hashes(pa.array([unpack(x)], pa.binary()).cast(pa.string()), SHINGLE)[1])


def _counts(batches):
    """How often shingles of a task's texts fall into each bucket."""
    tally = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for h in _own_hashes(batch.column("packed")):
            np.add.at(tally, _buckets(h), 1)
    at = np.flatnonzero(tally)
    yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "many": tally[at]})


def prefix(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first of a set's hashes in the common order, as many as one must share with a set of similarity 4/5: n - ceil(4/5 n) + 1."""
    return h[np.lexsort((h, frequent[_buckets(h)]))][: len(h) - -(-SHARE * len(h) // OF) + 1]


def _prefixes(frequent):
    """(row, label, packed) -> (token, place, row, label, n): a text's prefix."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                own = list(_own_hashes(part.column("packed")))
                found = [prefix(h, frequent.value) for h in own]
                sizes = [len(x) for x in found]
                whose = np.repeat(np.arange(len(own)), sizes)
                columns = {"token": np.concatenate([np.zeros(0, _U), *found]).view(np.int64), "place": np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])}
                columns |= {c: part.column(c).to_numpy()[whose] for c in ("row", "label")}
                yield pa.RecordBatch.from_pydict(columns | {"n": np.array([len(h) for h in own], np.int64)[whose]})

    return run


def prefix_pairs(rows: DataFrame) -> DataFrame:
    """rows(row, label, packed) -> pairs (a, b) with different labels, among them all of similarity 4/5 or more."""
    frequent = np.zeros(1 << ORDER_BITS, np.uint8)
    # 2^ORDER_BITS rows at most; of a count the order only needs its size, in quarters of an octave
    level = (F.log2(F.sum("many")) * 4).cast("byte")
    sums = rows.select("packed").mapInArrow(_counts, "bucket int, many long").groupBy("bucket").agg(level.alias("level")).where("level > 0").toArrow()
    frequent[sums["bucket"].to_numpy()] = sums["level"].to_numpy()
    del sums
    given = rows.sparkSession.sparkContext.broadcast(frequent)
    tokens = keep(rows.select("row", "label", "packed").mapInArrow(_prefixes(given), "token long, place long, row long, label long, n long"))
    of_label = tokens.groupBy("token", "label").agg(F.count("*").alias("k"))
    several = of_label.groupBy("token").agg(F.count("*").alias("labels"), F.max(F.struct("k", "label")).alias("most")).where("labels > 1").select("token", F.col("most.label").alias("most"))
    shared = keep(tokens.join(several, "token"))
    few = shared.where("label <> most").select("token", *[F.col(c).alias(f"{c}_b") for c in ("place", "row", "label", "n")])
    # of two rows without the most frequent label each meets the other: the pair is taken once
    once = (F.col("label") != F.col("label_b")) & ((F.col("label") == F.col("most")) | (F.col("row") < F.col("row_b")))
    left = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    met = shared.join(few, "token").where(once & _could("n", "n_b") & (left * (SHARE + OF) >= (F.col("n") + F.col("n_b")) * SHARE))
    return met.select(F.least("row", "row_b").alias("a"), F.greatest("row", "row_b").alias("b")).distinct()


def ring_pairs(reps: DataFrame) -> DataFrame:
    """reps(row, n, print) -> pairs (a, b) of rows by pigeonring filtering of their fingerprints: a tree of those within NEAR bits, and rows of one fingerprint with its first."""
    prints = reps.groupBy("print").agg(F.min(F.struct("row", "n")).alias("first"))
    first = keep(prints.select("print", F.col("first.row").alias("row"), F.col("first.n").alias("n")))
    of = lambda c: first.select(F.col("print").alias(c), F.col("row").alias(f"row_{c}"), F.col("n").alias(f"n_{c}"))
    near = links(first.select("print"), NEAR).join(of("a"), "a").join(of("b"), "b").select("row_a", "n_a", "row_b", "n_b")
    equal = reps.select("print", F.col("row").alias("row_b"), F.col("n").alias("n_b")).join(of("print").withColumnsRenamed({"row_print": "row_a", "n_print": "n_a"}), "print").where("row_a <> row_b")
    met = near.unionByName(equal.select("row_a", "n_a", "row_b", "n_b")).where(_could("n_a", "n_b"))
    return met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()


def groups(sketched: DataFrame, docs: DataFrame) -> DataFrame:
    """sketched(doc_key, tie, same, same_low, n, print, keys) of docs(doc_key, tie, text) -> (same, same_low, component) of all texts; linked ones share it."""
    names = ["same", "same_low"]
    reps = cut(sketched.dropDuplicates(names).select(F.monotonically_increasing_id().alias("row"), *names, "doc_key", "tie", "n", "print", "keys"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = reps.select(F.explode("keys").alias("key"), "row", "n")
    sorted_ = keyed.repartitionByRange(n, "key", "row").sortWithinPartitions("key", "row")
    near = cut(sorted_.mapInArrow(_neighbours, "key long, row long, n long, before long, n_before long"))
    ring = cut(ring_pairs(reps.select("row", "n", "print")))
    met = near.select("row").unionByName(ring.select(F.explode(F.array("a", "b")).alias("row")))
    chosen = cut(reps.join(met.distinct(), "row", "left_semi").select("row", "doc_key", "tie", "print"))
    keys = ["doc_key", "tie"]
    wanted = docs.select(*keys, "text").join(chosen.select(*keys), keys, "left_semi").dropDuplicates(keys)
    texts = cut(pack_texts(wanted, *keys).join(chosen, keys).select("row", "print", "packed"))

    beside = near.where("before is not null").where(_could("n", "n_before"))
    first = beside.where(F.pmod("key", F.lit(SAMPLE)) == 0).select(F.col("before").alias("a"), F.col("row").alias("b"))
    done = cut(compared(first.unionByName(ring).distinct(), texts))
    labels = components(done.where("linked"), "row", "label")

    def labelled(rows: DataFrame, row: str, label: str) -> DataFrame:
        known = labels.select(F.col("row").alias(row), F.col("label").alias(label))
        return rows.join(known, row, "left").withColumn(label, F.coalesce(label, row))

    second = labelled(labelled(beside, "row", "label"), "before", "label_before").where("label <> label_before")
    second = second.select(F.col("before").alias("a"), F.col("row").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
    done = cut(done.unionByName(compared(second, texts)))
    labels = components(done.where("linked"), "row", "label")
    rows = labelled(near.select("key", "row"), "row", "label")
    several = rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key")
    apart = rows.join(several, "key", "left_semi").select("row", "label").distinct().join(texts, "row")
    last = prefix_pairs(keep(apart.select("row", "label", "packed"))).join(done, ["a", "b"], "left_anti")
    done = cut(done.unionByName(compared(last, texts)))
    labels = components(done.where("linked"), "row", "component")
    return reps.select("row", *names).join(labels, "row", "left").select(*names, F.coalesce("component", "row").alias("component"))


def one_of_each_similar(docs: DataFrame) -> DataFrame:
    """The documents without similar ones: of each group the one with the smallest id stays."""
    rows = keyed_rows(docs)
    sketched = keep(sketches(rows.withColumn("doc_id", F.col("row.doc_id")), "doc_id", "doc_key", "tie"))
    with shuffles_removed(docs.sparkSession):
        found = groups(sketched.drop("doc_id"), rows)
    return first_of_each(hot_join(sketched.select("doc_id", "doc_key", "tie", "same", "same_low"), found, ["same", "same_low"], "doc_key"), docs, rows)


def brute_force(texts: dict[int, str | None]) -> dict[int, int]:
    """The smallest id of each one's group, by comparing all pairs of a few texts."""
    sets = {k: text_shingles(t, SHINGLE) for k, t in texts.items()}
    label = {k: k for k in texts}
    alike = [(i, j) for i in texts for j in texts if i < j and OF * len(sets[i] & sets[j]) >= SHARE * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in alike:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label
