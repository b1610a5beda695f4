"""Texts of an Arrow column as numpy arrays: bytes, words, and rolling hashes of words. Used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd factor for each byte value, and the bases of two independent polynomial hashes.
BYTE_CODES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
BLOCK = 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in a row, and where each begins (one more entry than values). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word `[^\\x20\\x09-\\x0D]+`, and for each text the number of words before it."""
    inner = ~SPACE[data]
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1]
    ends[:-1] &= ~inner[1:]
    first = at[:-1][(at[:-1] < at[1:])]
    begins[first] = inner[first]
    last = at[1:][(at[:-1] < at[1:])] - 1
    ends[last] = inner[last]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return b, e, np.searchsorted(b, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        n = max(n, 2 * BLOCK)
        up, down = np.full(n + 1, base, U), np.full(n + 1, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[base]


def span_hashes(values: np.ndarray, b: np.ndarray, e: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[b:e] for sorted spans, by prefix sums over blocks that stay in the processor's cache."""
    out = np.empty(len(b), U)
    i = 0
    while i < len(b):
        j = max(i + 1, int(np.searchsorted(e, b[i] + BLOCK, "right")))
        lo, hi = int(b[i]), int(e[j - 1])
        up, down = powers(base, hi - lo)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(values[lo:hi] * up[: hi - lo], out=sums[1:])
        s = b[i:j] - lo
        out[i:j] = (sums[e[i:j] - lo] - sums[s]) * down[s]
        i = j
    return out


def word_hashes(data: np.ndarray, b: np.ndarray, e: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; which: 0 or 1 for independent ones."""
    out = np.empty(len(b), U)
    i = 0
    while i < len(b):  # the byte codes too are made a block at a time
        j = max(i + 1, int(np.searchsorted(e, b[i] + BLOCK, "right")))
        lo = b[i]
        out[i:j] = span_hashes(BYTE_CODES[which][data[lo : e[j - 1]]], b[i:j] - lo, e[i:j] - lo, BASES[which])
        i = j
    return mix(out ^ ((e - b).astype(U) * U(0xA24BAED4963EE407)))


def window_hashes(words: np.ndarray, starts: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of the n words from each of the sorted starts."""
    return mix(span_hashes(words, starts, starts + n, BASES[1 - which]))


def window_starts(before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which n words of one text begin, and the number of its text."""
    counts = np.maximum(0, np.diff(before) - (n - 1))
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + before[:-1][doc], doc


def cover(starts: np.ndarray, n: int | np.ndarray, length: int) -> np.ndarray:
    """Mask of the positions covered by the spans [start, start + n)."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0
