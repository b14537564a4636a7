"""Vectorised text handling on Arrow buffers: words, 64-bit word hashes and shingle hashes with NumPy, no Python loop over words.

Hashes are polynomial in the bytes modulo 2**64 (so that all words of a slice come from one running sum), then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            tables.append(np.cumprod(a, dtype=np.uint64))
        if n > 8 * SLICE_BYTES:  # one very long text: not kept
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the rows' offsets in them; nulls are empty."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def release() -> None:
    """Gives memory that a finished task no longer needs back to the system, as workers live on between stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 1 << 30):
    """Ranges of at most `rows` rows that hold at most `most` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1), i + rows)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words (runs of bytes that aren't ASCII white space) of rows laid end to end."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand."""
    up, down = _power_tables(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words of rows, A-Z lower-cased."""
    base = offsets[0]
    part = LOWER[data[base : offsets[-1]]]
    s, e, row = words(part, offsets - base)
    return span_hashes(part, s, e), row


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of k words; a row of fewer words, but not none, is one window."""
    by = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
    m = len(hashes)
    if m >= k:
        ok = row[: m - k + 1] == row[k - 1 :]
        s = np.zeros(m - k + 1, np.uint64)
        for j in range(k):
            s += hashes[j : m - k + 1 + j] * by[j]
        out, out_row = mix(s[ok]), row[: m - k + 1][ok]
    else:
        out, out_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(row, minlength=n_rows)
    small = np.flatnonzero((counts > 0) & (counts < k))
    if len(small):
        first = np.searchsorted(row, small)
        extra = np.array([mix(np.sum(hashes[f : f + c] * by[:c], dtype=np.uint64, keepdims=True) + np.uint64(c))[0] for f, c in zip(first, counts[small])], np.uint64)
        out, out_row = np.concatenate([out, extra]), np.concatenate([out_row, small])
        order = np.argsort(out_row, kind="stable")
        out, out_row = out[order], out_row[order]
    return out, out_row


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A large-binary Arrow column whose row i is data[bounds[i]:bounds[i+1]], without copies for each row."""
    data = np.ascontiguousarray(data)
    size = data.dtype.itemsize
    if int(bounds[-1]) * size < (1 << 31):
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((np.asarray(bounds) * size).astype(np.int32)), pa.py_buffer(data)])
    raw = data.view(np.uint8)
    return pa.array([raw[a * size : b * size].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def _letter_table() -> np.ndarray:
    t = LOWER.copy()
    keep = np.zeros(256, bool)
    keep[65:91] = keep[97:123] = True
    keep[128:] = True
    t[~keep] = 0x20
    return t


LETTERS = _letter_table()


def byte_ngram_counts(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], width: int) -> np.ndarray:
    """Rows x width: counts of hashed n-grams of bytes (letters lower-cased, all else in ASCII a blank)."""
    base, n_rows = offsets[0], len(offsets) - 1
    part = LETTERS[data[base : offsets[-1]]].astype(np.uint32)
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    out = np.zeros(n_rows * width, np.float32)
    code = part.copy()
    for n in range(1, max(sizes) + 1):
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) ^ part[n - 1 :] if len(code) else code
        if n in sizes and len(code):
            ok = row[: len(code)] == row[n - 1 :]
            h = code[ok] * np.uint32(0x9E3779B1 + 2 * n)
            h = (h ^ (h >> np.uint32(15))) & np.uint32(width - 1)
            out += np.bincount(row[: len(code)][ok] * width + h, minlength=len(out))
    return out.reshape(n_rows, width)


def byte_ngrams(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], width: int) -> np.ndarray:
    """Rows x width: log counts of hashed n-grams of bytes, each row of length 1."""
    return unit_logs(byte_ngram_counts(data, offsets, sizes, width))


def unit_logs(counts: np.ndarray) -> np.ndarray:
    """Logs of counts, each row of length 1."""
    x = np.log1p(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
