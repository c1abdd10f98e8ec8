"""Document fingerprints: 128-bit SimHash, and a search within a Hamming radius by permuted block tables.

All of it is DataFrame functions. A text's terms are its pairs of neighbouring words (the last word also
stands alone); every occurrence votes on each bit of the term's two 64-bit hashes, with the term's
length (31 at most) as its weight, and a bit is one where more than half of the weight says so. The votes
for four bits share one long, so 32 sums count 128 bits.

The search keeps a table for every choice of `leading` out of `radius + leading` blocks of bits, in which
those blocks come first: two fingerprints within the radius agree in one of these choices.

Cases: a null text is an empty one; texts without words have fingerprint zero; equal texts have equal
fingerprints; rows may repeat or share doc_id (such ties are ordered by text); null ids come last; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, keep, table

RADIUS, LEADING = 4, 2
WORDS = 2  # longs of 64 bits
LOWEST = -(1 << 63)
#: Terms in a chunk and the largest weight: together below 2^15, as the topmost votes share the long's sign.
CHUNK, MOST = 1024, 31
_FOUR, _TWO = 0x0001000100010001, 0x0000FFFF0000FFFF


def terms(text: Column) -> Column:
    """A struct for each pair of neighbouring words (the last word is paired with null): hashes and weight.

    The words are bound as a variable, so the text is split once.
    """

    def of(w: Column) -> Column:
        def term(a: Column, i: Column) -> Column:
            b = F.get(w, i + 1)
            weight = F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(MOST)).cast("long")
            return F.struct(F.xxhash64(a, b).alias("h0"), weight.alias("weight"))

        return F.transform(w, term)

    for c in "\t\n\x0b\x0c\r":  # splitting at one plain character takes no regular expression
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.transform(F.array(F.array_remove(F.split(text, " "), "")), of)[0]


def _votes() -> list[Column]:
    """Sums over a chunk's terms: the whole weight, and the votes for four bits in each long."""
    out = [F.sum("weight").alias("weight")]
    for k in range(WORDS):
        out += [F.sum(F.shiftrightunsigned(f"h{k}", i).bitwiseAND(F.lit(_FOUR)) * F.col("weight")).alias(f"v{k}_{i}") for i in range(16)]
    return out


def _widened() -> list[Column]:
    """Sums over a text's chunks, with the votes for two bits in each long."""
    out = [F.sum("weight").alias("weight")]
    for k in range(WORDS):
        for i in range(16):
            v = F.col(f"v{k}_{i}")
            out += [F.sum(F.shiftrightunsigned(v, 16 * j).bitwiseAND(F.lit(_TWO))).alias(f"w{k}_{i + 16 * j}") for j in (0, 1)]
    return out


def _majority(k: int) -> Column:
    """The k-th long of a fingerprint from its votes."""
    votes = ", ".join(f"w{k}_{i}" for i in range(32))
    low, high = "cast((v & 4294967295) * 2 > weight as bigint)", "cast(shiftrightunsigned(v, 32) * 2 > weight as bigint)"
    bits = f"transform(array({votes}), (v, i) -> shiftleft({low}, i) | shiftleft({high}, i + 32))"
    return F.expr(f"aggregate({bits}, 0L, (s, x) -> s | x)")


def fingerprints(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, print: array of two longs) for rows(keys, text), which the keys tell apart.

    Votes are counted in chunks of CHUNK terms, in which they fit 15 bits.
    """
    words = rows.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("_at", "_term"))
    chunk = F.shiftright(F.coalesce("_at", F.lit(0)), CHUNK.bit_length() - 1)
    h0 = F.coalesce("_term.h0", F.lit(0))
    more = [F.xxhash64(h0, F.lit(k)).alias(f"h{k}") for k in range(1, WORDS)]
    chunks = words.select(*keys, chunk.alias("_chunk"), h0.alias("h0"), *more, F.coalesce("_term.weight", F.lit(0)).alias("weight")).groupBy(*keys, "_chunk").agg(*_votes())
    voted = chunks.groupBy(*keys).agg(*_widened())
    return voted.select(*keys, F.array(*[_majority(k) for k in range(WORDS)]).alias("print"))


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _block_keys(value: Column, radius: int, leading: int) -> Column:
    n = radius + leading
    edges = [64 * WORDS * i // n for i in range(n + 1)]
    out = []
    for t, chosen in enumerate(combinations(range(n), leading)):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        parts = [(mask >> 64 * k) & ((1 << 64) - 1) for k in range(WORDS)]
        out.append(F.xxhash64(F.lit(t), *[value[k].bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for k, m in enumerate(parts) if m]))
    return F.array(*out)


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, leading: int = LEADING) -> DataFrame:
    """All (query, print, apart) of different queries(print) and prints(print) at most `radius` bits apart, each once."""
    q = queries.select(F.col("print").alias("query")).distinct()
    q = q.select("query", F.explode(_block_keys(F.col("query"), radius, leading)).alias("key"))
    p = prints.select("print").distinct()
    p = p.select("print", F.explode(_block_keys(F.col("print"), radius, leading)).alias("key"))
    met = q.join(p, "key").select("query", "print", distance(F.col("query"), F.col("print")).alias("apart"))
    return met.where(F.col("apart") <= radius).distinct()


def buckets(docs: DataFrame, order: Column, n: int) -> Column:
    """Number of a row's range of `order`, below n, of about n ranges with as many rows each.

    The ends of the ranges are looked up in two steps, so a row is compared with about 2 sqrt(n) of them.
    """
    found = docs.select(F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n).alias("p")).head() if n > 1 else None
    ends = sorted(set(found.p)) if found and found.p else []
    step = max(1, isqrt(len(ends)))
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    if not groups:
        return F.lit(0)
    coarse = F.array(*[F.lit(g[-1]) for g in groups])
    fine = F.array(*[F.array(*map(F.lit, g)) for g in [*groups, []]]).cast("array<array<long>>")
    g = F.size(F.filter(coarse, lambda x: x < order))
    return F.least(g * step, F.lit(len(ends))) + F.size(F.filter(F.element_at(fine, g + 1), lambda x: x < order))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the text that follows in descending order of doc_id, the first's after the last's.

    Rows are dealt by ranges of doc_id, each of which is a task's. Each range also gets the first row of the range below it (`extra`;
    the lowest gets the very first row), so that no row has to leave its range to find the next.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("k"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("range", buckets(rows, F.col("k"), n))
    # one row for each range: at most as many as there are partitions
    firsts = rows.groupBy("range").agg(F.max("k").alias("k"))
    below = F.lag("k").over(Window.orderBy("range"))
    firsts = firsts.withColumn("k", F.coalesce(below, F.max("k").over(Window.partitionBy(F.lit(0))))).withColumnRenamed("range", "above")
    extra = rows.join(F.broadcast(firsts), "k").groupBy("above", "k").agg(F.min("text").alias("text"))
    # the lowest range is followed by the very first row, which must sort after all others
    extra = extra.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(LOWEST).alias("k"), F.col("above").alias("range"), F.lit(1).alias("extra"))
    whole = rows.withColumn("extra", F.lit(0)).unionByName(extra).repartitionById(n, F.col("range").cast("int"))
    w = Window.partitionBy("range").orderBy("extra", F.desc("k"), "text")
    return whole.select("doc_id", "text", "range", "extra", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next_text"))


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and near_rows: for every id divisible by 100, how many other rows are within the radius."""
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"), F.expr("substring(next_text, 1, length(text) div 3)"))
    rows = rows.select("range", "place", "extra", "doc_id", n.cast("long").alias("n_chars"), "text", F.coalesce(edited, F.lit("")).alias("edited")).withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    sides = rows.select("range", "place", "extra", "doc_id", "n_chars", "edited_sha256", F.posexplode(F.array("text", "edited")).alias("side", "version"))
    prints = fingerprints(sides, "version", "range", "place", "extra", "doc_id", "n_chars", "edited_sha256", "side")
    w = Window.partitionBy("range").orderBy("place", "side")
    done = prints.withColumn("edited_print", F.lead("print", 1).over(w)).withColumn("next_print", F.lead("print", 2).over(w)).where("side = 0 and extra = 0")
    done = keep(done.select("doc_id", "n_chars", "edited_sha256", "print", "edited_print", "next_print"))

    members = done.groupBy("print").agg(F.count("*").alias("rows"))
    asked = done.where("doc_id % 100 = 0").select("print")
    near = within_radius(asked, members).join(members, "print").groupBy(F.col("query").alias("print")).agg(F.sum("rows").alias("near"))
    done = hot_join(done, near, "print", "edited_sha256", "left")

    hexed = lambda c: F.lower(F.concat(*[F.lpad(F.hex(F.col(c)[k]), 16, "0") for k in range(WORDS)]))
    alike = lambda c: 1 - distance(F.col("print"), F.col(c)) / F.lit(64.0 * WORDS)
    return done.select("doc_id", "n_chars", "edited_sha256", hexed("print").alias("fingerprint"), hexed("edited_print").alias("edited_fingerprint"), alike("edited_print").alias("near_edited"), alike("next_print").alias("near_next"), F.when(F.col("doc_id") % 100 == 0, F.col("near") - 1).alias("near_rows"))
