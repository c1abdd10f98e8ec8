"""Anchors: sampled positions at which equal windows of different documents meet.

Every window of `width` symbols picks, among the `gram`-symbol strings inside it, the one with the
smallest hash (the leftmost of equal ones). Equal windows pick the same place, so windows that occur
twice are found by comparing about 2 / (width - gram + 2) places for each symbol and not all of them.
The windows that pick one place are consecutive; together with their symbols they are its context.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import SPACES

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POSITION = _U(0xFFFFFF)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[np.frombuffer(SPACES, np.uint8)] = True


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    out, step = np.ones(1 << bits, _U), base
    for k in range(bits):
        out[1 << k : 2 << k] = out[: 1 << k] * _U(step)
        step = step * step % (1 << 64)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for each pair; depends on the symbols only."""
    n = len(symbols)
    bits = max(21, int(n).bit_length())
    down, up = _powers(pow(_BASE, -1, 1 << 64), bits), _powers(_BASE, bits)
    sums = np.zeros(n + 1, _U)
    np.cumsum(symbols * down[:n], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * up[starts])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, _U(2**64 - 1))
    padded[:n] = x
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(symbols: np.ndarray, ends: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of documents that stand one after another in `symbols`, each ending before its `ends`.

    doc: index of the document; at, low, high: place of the anchor and of the first and last window
    that picks it, in `symbols`; core: hash of the anchor's string.
    """
    n = len(symbols)
    if n < width or n > int(_POSITION):
        if n > int(_POSITION):
            raise ValueError("a block is too long")
        none = np.zeros(0, np.int64)
        return {"doc": none, "at": none, "low": none, "high": none, "core": none.astype(_U)}
    first = np.arange(n - gram + 1)
    hashes = span_hashes(symbols, first, first + gram)
    picked = _sliding_min((hashes & ~_POSITION) | first.astype(_U), width - gram + 1) & _POSITION
    picked = picked.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    lengths = np.maximum(ends - starts - width + 1, 0)
    doc = np.repeat(np.arange(len(ends)), lengths)
    window = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    place = picked[window]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(place))[: len(lo)] - 1
    return {"doc": doc[lo], "at": place[lo], "low": window[lo], "high": window[hi], "core": hashes[place[lo]]}


def context_hashes(symbols: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each symbols[low:end]."""
    size, view = symbols.itemsize, memoryview(np.ascontiguousarray(symbols)).cast("B")
    return np.fromiter((xxhash.xxh3_64_intdigest(view[i * size : j * size]) for i, j in zip(low.tolist(), end.tolist())), _U, len(low))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, and where each row ends; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds[1:] - bounds[0]


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and how many words have come by the end of each row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = ~_IS_SPACE[raw]
    first = np.zeros(len(raw), bool)
    first[0] = True
    first[ends[:-1][ends[:-1] < len(raw)]] = True
    start = inside & first
    start[1:] |= inside[1:] & ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, ends, side="left")


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _byte_codes()[raw]


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    return span_hashes(byte_symbols(raw), s, e) if len(s) else np.zeros(0, _U)
