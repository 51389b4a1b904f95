"""Vectorised work on batches of UTF-8 texts: every function takes the bytes of many documents end to end plus their offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}

#: Bytes that belong to words: ASCII letters and digits, and all of non-ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def utf8(arr: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    a = pc.fill_null(arr.cast(pa.large_string()), "")
    if lower:
        a = pc.utf8_lower(a)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, max_rows: int = 8000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds about max_bytes of text (a longer text comes alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            base = end[at - 1] if at else 0
            to = max(at + 1, min(int(np.searchsorted(end, base + max_bytes, "right")), at + max_rows))
            yield b.slice(at, to - at)
            at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_POW.get("p", ())) < n:
        m = max(n, 1 << 20)
        for key, base in (("p", _P), ("q", _P_INV)):
            x = np.full(m, base & ((1 << 64) - 1), U64)
            x[0] = 1
            _POW[key] = np.multiply.accumulate(x)
    return _POW["p"][:n], _POW["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), by prefix sums of a polynomial hash."""
    p, q = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=h[1:])
    return mix((h[end] - h[start]) * q[start] + (end - start).astype(U64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begins = w.copy()
    begins[1:] &= ~w[:-1] | cut[1:n]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | cut[1:n]
    s = np.flatnonzero(begins)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed word n-grams of each document, sorted within it, and where each document's begin. A document of 1 to n-1 words has one gram, all its words; one without words has none. Hashes keep 50 bits; at most 16,384 documents a call."""
    s, e, first = words(data, off)
    h = span_hashes(data, s, e)
    have = np.diff(first)
    count = np.where(have >= n, have - n + 1, np.minimum(have, 1))
    doc = np.repeat(np.arange(len(have)), count)
    total = int(count.sum())
    begin = np.cumsum(count) - count
    at = np.arange(total) - np.repeat(begin, count) + np.repeat(first[:-1], count)
    last = np.repeat(first[1:], count)
    g = np.zeros(total, U64)
    for j in range(n):
        ok = at + j < last
        x = h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else g
        g = np.where(ok, mix(g * U64(0x9FB21C651E98DF25) + x), g)
    key = (doc.astype(U64) << U64(50)) | (g >> U64(14))
    key = np.unique(key)
    d = (key >> U64(50)).astype(np.int64)
    return key & U64((1 << 50) - 1), np.searchsorted(d, np.arange(len(have) + 1))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of True."""
    d = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
