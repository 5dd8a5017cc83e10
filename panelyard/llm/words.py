"""Hashes of words and word n-grams of whole texts, computed on the bytes of an Arrow column.

A word is a maximal run of bytes other than ASCII white space. Work proceeds in slices of about two million bytes, so
a task's memory does not depend on how many texts an Arrow batch holds; a longer text is a slice of its own and is
hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(count: int, seed: int) -> np.ndarray:
    """``count`` fixed pseudo-random odd 64-bit numbers."""
    start = np.uint64(seed * 0x100000001 + 1)
    return mix(start + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_POWERS["up"]) < count:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(count, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:count], _POWERS["down"][:count]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row bounds in them; a null counts as empty."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    held = filled.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    _, bounds = raw_bytes(texts)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        stop = min(max(stop, at + 1), len(texts))
        yield at, stop
        at = stop


def word_spans(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte position of each word, and each row's bounds in the list of words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    gap = space[data]
    full = bounds[:-1] < bounds[1:]
    heads, tails = bounds[:-1][full], bounds[1:][full] - 1
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    first[heads] = ~gap[heads]
    last[:-1] &= gap[1:]
    last[tails] = ~gap[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last), np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")), at + 1)
        low, high = starts[at], ends[stop - 1] + 1
        up, down = powers(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low + 1
        out[at:stop] = mix((sums[e] - sums[s]) * down[s])
        at = stop
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, and the row bounds."""
    data, bounds = raw_bytes(texts)
    starts, ends, rows = word_spans(data, bounds)
    return span_hashes(data, starts, ends), rows


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int, short: bool = False, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` neighbouring words inside a row, and the row bounds.

    With ``short``, a row of fewer words gives one n-gram of all it has; a row without words gives none.
    """
    counts = np.diff(bounds)
    made = np.maximum(counts - n + 1, 0)
    weights = salts(n, seed)
    total = max(len(hashes) - n + 1, 0)
    grams = np.zeros(total, np.uint64)
    for j in range(n):
        grams += hashes[j : j + total] * weights[j]
    if total:
        row = np.repeat(np.arange(len(counts)), counts)
        grams = grams[row[:total] == row[n - 1 :]]
    out = np.concatenate([[0], np.cumsum(made)])
    if short and len(tiny := np.flatnonzero((counts > 0) & (counts < n))):
        values = [np.uint64(np.sum(hashes[bounds[i] : bounds[i + 1]] * weights[: counts[i]])) for i in tiny]
        grams = np.insert(grams, out[tiny], np.array(values, np.uint64))
        made[tiny] = 1
        out = np.concatenate([[0], np.cumsum(made)])
    return mix(grams), out
