"""Vectorised word and shingle hashing over Arrow text buffers.

Words are hashed by prefix sums of a polynomial modulo 2**64, so the cost is a
few array passes over the bytes and never a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15
_K = U(0xD6E8FEB86659FD93)
SPACES = (32, 9, 10, 11, 12, 13)
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeded(i: int) -> np.uint64:
    return mix(np.array([(i * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019) % 2**64], U))[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            a = np.full(max(n, 1 << 16), base, U)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U)
    return _powers[0], _powers[1]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; nulls count as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o.astype(np.int64), d


def slices(off: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row comes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lowered words of each row and the rows' word offsets.

    Words are maximal runs of bytes other than space and 0x09-0x0D.
    """
    o = off - off[0]
    d = data[off[0] : off[-1]]
    n = len(d)
    if not n:
        return np.zeros(0, U), np.zeros(len(o), np.int64)
    d = d + (((d >= 65) & (d <= 90)).view(np.uint8) << np.uint8(5))
    space = (d == 32) | ((d >= 9) & (d <= 13))
    cut = np.zeros(n + 1, bool)
    cut[o] = True
    edge = space[:-1] | cut[1:n]
    start, end = ~space, ~space
    start[1:] &= edge
    end[:-1] &= space[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = powers(n + 1)
    h = np.zeros(n + 1, U)
    np.cumsum((d.astype(U) + U(1)) * power[:n], out=h[1:])
    w = mix((h[e] - h[s]) * inverse[s] + (e - s).astype(U) * _K)
    return w, np.searchsorted(s, o).astype(np.int64)


def word_runs(data: np.ndarray, off: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and word offsets of slices of rows of about ``most`` bytes; a longer row is hashed in parts that end at white space."""
    for i, j in slices(off, most):
        a, b = int(off[i]), int(off[j])
        if b - a <= 2 * most:
            yield word_hashes(data, off[i : j + 1])
            continue
        parts = []
        while a < b:
            c = min(a + most, b)
            while c < b and data[c] not in SPACES:
                c += 1
            parts.append(word_hashes(data, np.array([a, c]))[0])
            a = c
        w = np.concatenate(parts)
        yield w, np.array([0, len(w)])


def shingle_sets(w: np.ndarray, wo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and offsets.

    A row with fewer than ``width`` words has its whole sequence as its one
    shingle; a row without words has none.
    """
    n = len(w) - width + 1
    if n > 0:
        x = w[:n].copy()
        for j in range(1, width):
            x = x * _K + w[j : n + j]
        x = mix(x)
    out, off = [], np.zeros(len(wo), np.int64)
    for i in range(len(wo) - 1):
        a, b = wo[i], wo[i + 1]
        if b - a >= width:
            seg = np.sort(x[a : b - width + 1])
            seg = seg[np.concatenate(([True], seg[1:] != seg[:-1]))]
        elif b > a:
            v = seeded(int(b - a))
            seg = w[a:b]
            for y in seg:
                v = mix(np.array([v], U) * _K + y)[0]
            seg = np.array([v], U)
        else:
            seg = w[:0]
        out.append(seg)
        off[i + 1] = off[i] + len(seg)
    return (np.concatenate(out) if out else w[:0]), off


def rows_of(off: np.ndarray) -> np.ndarray:
    """For each element the number of its row."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))
