"""Distributed merge sort of byte strings that never compares a known common prefix again.

Each map task sorts what it holds into a run, cuts the run at the splitters and sends every piece
front-coded: a string is its common prefix length with the string before it and the bytes after that.
A reducer merges the pieces with a loser tree whose nodes carry common prefix lengths (LCPs): of two
candidates the one that shares more with the string last put out is the smaller, and only where both
share as much are bytes compared, from that point on.

Ranges meet at their splitters. For strings i >= splitter > j, LCP(i, j) is the smaller of the LCPs
with the splitter, so what a range must know of its neighbours are these numbers, not strings.

Splitters are found on a sorted sample, by Spark; of each only what tells it from the string before it
goes to the driver, one for `RANGE_ROWS` strings, and from there to the tasks as one broadcast.

Strings come as rows (string, core, context, depth, limit); the last four are a string's name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that a range holds on average, and strings sampled for each splitter.
RANGE_ROWS = 20_000
SAMPLE_PER_RANGE = 16
#: Strings that a task sorts into one run.
RUN_ROWS = 40_000

#: Numbers in a name.
NAME = 4

_RUN_SCHEMA = "part int, lcps binary, lens binary, bytes binary, names binary, below binary, above binary"


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that the first `known` bytes agree."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merge of sorted runs; iterating gives (run, LCP with the string given before) in order.

    next_of(run) gives the run's next (string, name, LCP with its predecessor in the run) or None.
    """

    def __init__(self, next_of: list[Callable]):
        self.k = 1 << max(0, len(next_of) - 1).bit_length()
        self.next_of = next_of
        self.head = [f() for f in next_of] + [None] * (self.k - len(next_of))
        self.lcp = [0] * self.k
        self.loser = [-1] * self.k
        self.winner = self._build(1)

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's LCP is then that with the winner."""
        a, b = self.head[i], self.head[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        p, q = self.lcp[i], self.lcp[j]
        if p != q:
            return (i, j) if p > q else (j, i)
        x, y = a[0], b[0]
        n = common_prefix(x, y, p)
        if (x[n:], a[1]) <= (y[n:], b[1]) if n == min(len(x), len(y)) else x[n] < y[n]:
            self.lcp[j] = n
            return i, j
        self.lcp[i] = n
        return j, i

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        w, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return w

    def __iter__(self) -> Iterator[tuple[bytes, tuple, int]]:
        while (top := self.head[self.winner]) is not None:
            w = self.winner
            yield top[0], top[1], self.lcp[w]
            self.head[w] = following = self.next_of[w]()
            self.lcp[w] = following[2] if following else 0
            node = (w + self.k) >> 1
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node >>= 1
            self.winner = w


def _encode(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    lcps = np.zeros(len(strings), np.int32)
    for i in range(1, len(strings)):
        lcps[i] = common_prefix(strings[i - 1], strings[i])
    rest = [s[n:] for s, n in zip(strings, lcps.tolist())]
    return lcps, np.array([len(s) for s in rest], np.int32), b"".join(rest)


def _decode(lcps: bytes, lens: bytes, data: bytes, names: bytes) -> Callable:
    name = np.frombuffer(names, np.int64).reshape(-1, NAME).tolist()
    sizes = np.frombuffer(lens, np.int32)
    ends = np.cumsum(sizes).tolist()
    rows = zip(np.frombuffer(lcps, np.int32).tolist(), sizes.tolist(), ends, name)
    last = b""

    def following():
        nonlocal last
        for n, size, end, x in rows:
            last = last[:n] + data[end - size : end]
            return last, tuple(x), n
        return None

    return following


def _shared(strings: list[bytes], at: int, step: int, splitter: bytes, group: int) -> np.ndarray:
    """The different LCPs with the splitter among strings[at], strings[at + step], ..., within its first `group` bytes' group."""
    out: list[int] = []
    n = len(splitter)
    while 0 <= at < len(strings):
        n = common_prefix(strings[at][:n], splitter[:n])
        if n < group:
            break
        if not out or out[-1] != n:
            out.append(n)
        if n == group or not group and len(out) == 1:
            break
        # the next string that shares less: strings between share n with the splitter
        lo, hi = (at + 1, len(strings)) if step > 0 else (-1, at)
        head = splitter[:n]
        if step > 0:
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if strings[mid][:n] == head else (lo, mid)
            at = lo
        else:
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if strings[mid][:n] == head else (mid, hi)
            at = hi - 1
    return np.array(out, np.int32)


def _runs(given: Broadcast, group: int) -> Callable:
    def emit(rows: list[tuple[bytes, tuple]]) -> pd.DataFrame:
        splitters = given.value
        rows.sort()
        strings = [s for s, _ in rows]
        cuts = [0, *(bisect_left(rows, x) for x in splitters), len(rows)]
        out = []
        for part in range(len(cuts) - 1):
            i, j = cuts[part], cuts[part + 1]
            below = _shared(strings, i - 1, -1, splitters[part - 1][0], group) if part else np.zeros(0, np.int32)
            above = _shared(strings, j, 1, splitters[part][0], group) if part < len(splitters) else np.zeros(0, np.int32)
            if i == j and not len(below) and not len(above):
                continue
            lcps, lens, data = _encode(strings[i:j])
            names = np.array([x for _, x in rows[i:j]], np.int64).reshape(-1, NAME)
            out.append((part, lcps.tobytes(), lens.tobytes(), data, names.tobytes(), below.tobytes(), above.tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _RUN_SCHEMA.split(", ")])

    def run(batches):
        rows: list[tuple[bytes, tuple]] = []
        for pdf in batches:
            rows += zip(map(bytes, pdf["string"]), zip(*(pdf[c].tolist() for c in ("core", "context", "depth", "limit"))))
            if len(rows) >= RUN_ROWS:
                yield emit(rows)
                rows = []
        if rows:
            yield emit(rows)

    return run


def merged(pdf: pd.DataFrame) -> list[tuple[bytes, tuple, int]]:
    """A range's strings in order, with their LCPs."""
    return list(LoserTree([_decode(*x) for x in zip(pdf["lcps"], pdf["lens"], pdf["bytes"], pdf["names"])]))


def _best(given: Broadcast) -> Callable:
    """For each string, the longest prefix that any other string shares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        splitters = given.value
        part, rows = int(pdf["part"].iloc[0]), merged(pdf)
        n = len(rows)
        lcps = np.zeros(n + 1, np.int64)
        lcps[1:n] = [x[2] for x in rows[1:]]
        for column, at, edge in (("below", 0, part - 1), ("above", n, part)):
            most = max((int(np.frombuffer(x, np.int32).max()) for x in pdf[column] if x), default=0)
            if n and most:
                lcps[at] = min(most, common_prefix(splitters[edge][0], rows[0 if at == 0 else n - 1][0]))
        names = np.array([x[1] for x in rows], np.int64).reshape(-1, NAME)
        return pd.DataFrame({"core": names[:, 0], "context": names[:, 1], "depth": names[:, 2].astype(np.int32), "limit": names[:, 3].astype(np.int32), "shared": np.maximum(lcps[:-1], lcps[1:]).astype(np.int32)})

    return run


def _depths(given: Broadcast, group: int) -> Callable:
    """For each string, the different lengths that it shares with other strings of its group."""

    def chain(lcps: list[int], start: list[int]) -> list[list[int]]:
        out, stack = [], start
        for n in lcps:
            while stack and stack[-1] >= n:
                stack.pop()
            if n >= group:
                stack.append(n)
            else:
                stack.clear()
            out.append(list(stack))
        return out

    def edge(pdf: pd.DataFrame, column: str, splitter: bytes | None, string: bytes) -> tuple[list[int], int]:
        """The chain that comes from the neighbour, and the LCP with which it starts."""
        values = sorted({int(v) for x in pdf[column] if x for v in np.frombuffer(x, np.int32)})
        own = common_prefix(splitter, string) if splitter is not None and values else 0
        return [v for v in values if v < own], min(own, values[-1]) if values else 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        splitters = given.value
        part, rows = int(pdf["part"].iloc[0]), merged(pdf)
        n = len(rows)
        if not n:
            return pd.DataFrame({"core": [], "context": [], "depths": []})
        lcps = [x[2] for x in rows]
        low, lcps[0] = edge(pdf, "below", splitters[part - 1][0] if part else None, rows[0][0])
        high, last = edge(pdf, "above", splitters[part][0] if part < len(splitters) else None, rows[-1][0])
        down, up = chain(lcps, low), chain([last, *lcps[:0:-1]], high)[::-1]
        return pd.DataFrame({"core": [x[1][0] for x in rows], "context": [x[1][1] for x in rows], "depths": [sorted({v - group for v in [*a, *b]}) for a, b in zip(down, up)]})

    return run


def _short(every: int) -> Callable:
    """Of each sorted part of a sample every so many strings, cut after what tells it from the one before; only equal ones keep their names."""

    def run(batches):
        before, at = None, 0
        for pdf in batches:
            out = []
            for string, *name in zip(map(bytes, pdf["string"]), *(pdf[c].tolist() for c in ("core", "context", "depth", "limit"))):
                at += 1
                if at % every == 0:
                    same = string == before
                    out.append((string if before is None or same else string[: common_prefix(before, string) + 1], name if same else []))
                before = string
            yield pd.DataFrame(out, columns=["string", "name"])

    return run


def _splitters(strings: DataFrame, total: int, parts: int) -> list[tuple[bytes, tuple]]:
    if parts < 2:
        return []
    every = max(1, total // (parts * SAMPLE_PER_RANGE))
    sample = strings.where(F.pmod(F.xxhash64("core", "context", "depth"), F.lit(every)) == 0).orderBy("string", "core", "context", "depth")
    short = sample.mapInPandas(_short(SAMPLE_PER_RANGE), "string binary, name array<long>")
    return sorted({(bytes(r.string), tuple(r.name)) for r in short.toLocalIterator()})


def _sorted(strings: DataFrame, group: int) -> tuple[DataFrame, Broadcast]:
    """Front-coded pieces of sorted runs by range, and the splitters between the ranges."""
    total = strings.count()
    splitters = _splitters(strings, total, -(-total // RANGE_ROWS))
    given = strings.sparkSession.sparkContext.broadcast(splitters)
    runs = strings.mapInPandas(_runs(given, group), _RUN_SCHEMA)
    # a range to a task
    return runs.repartitionById(len(splitters) + 1, F.col("part")), given


def longest_shared(strings: DataFrame) -> DataFrame:
    """strings(string, name) -> (name, shared): the longest prefix shared with any other row."""
    runs, given = _sorted(strings, 0)
    return runs.groupBy("part").applyInPandas(_best(given), "core long, context long, depth int, limit int, shared int")


def shared_lengths(strings: DataFrame, group: int) -> DataFrame:
    """(core, context, depths): the lengths, counted after the first `group` bytes, that a string shares with others that agree in these."""
    runs, given = _sorted(strings, group)
    return runs.groupBy("part").applyInPandas(_depths(given, group), "core long, context long, depths array<int>")
