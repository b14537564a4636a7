"""Elias-Fano sequences of sorted 64-bit numbers with vectorised search and access, byte-packed integers, and files of arrays that are memory-mapped."""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

import numpy as np

_64 = np.uint64(64)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays that hold ascending uint64 numbers: packed low bits, unary high bits, and zeros before each word of these."""
    n = len(keys)
    low_bits = max(0, int(int(keys[-1]) // n).bit_length() - 1) if n else 0
    high = (keys >> np.uint64(low_bits)).astype(np.int64)
    bits = np.zeros((int(high[-1]) + n + 1 if n else 1) // 64 * 64 + 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
    low = np.zeros(n * low_bits // 64 + 2, np.uint64)
    if low_bits and n:
        step = 1 << 18
        packed = []
        for i in range(0, n, step):  # step * low_bits is a multiple of 64
            part = keys[i : i + step]
            b = ((part[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed.append(np.packbits(b.ravel(), bitorder="little"))
        raw = np.concatenate(packed)
        low.view(np.uint8)[: len(raw)] = raw
    return {"high": words, "zeros": zeros, "low": low, "shape": np.array([n, low_bits], np.int64)}


class Sequence:
    def __init__(self, a: dict[str, np.ndarray]):
        self.high, self.zeros, self.low = a["high"], a["zeros"], a["low"]
        self.n, self.low_bits = (int(x) for x in a["shape"])
        self._ones: np.ndarray | None = None

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        w, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[w] >> off
        spill = off + np.uint64(self.low_bits) > _64
        if spill.any():
            x[spill] |= self.low[w[spill] + 1] << (_64 - off[spill])
        return x & np.uint64((1 << self.low_bits) - 1)

    def _select(self, before: np.ndarray, number: np.ndarray, ones: bool) -> np.ndarray:
        """Place of one or zero number `number`, from 0; before: how many stand before each word."""
        w = np.searchsorted(before, number, side="right") - 1
        left = number - before[w]
        x = self.high[w] if ones else ~self.high[w]
        place = np.zeros(len(number), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            there = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= there
            left = np.where(up, left - there, left)
            place += np.where(up, width, 0)
            x = np.where(up, x >> np.uint64(width), x)
        return w * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        if self._ones is None:
            self._ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        return ((self._select(self._ones, i, True) - i) << self.low_bits) | self._low(i).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1: the successor search within the run of equal high bits."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        high = (keys >> np.uint64(self.low_bits)).astype(np.int64)
        ok = np.flatnonzero(high < self.zeros[-1])
        h = high[ok]
        hi = self._select(self.zeros, h, False) - h
        before = np.maximum(h - 1, 0)
        lo = np.where(h > 0, self._select(self.zeros, before, False) - before, 0)
        want = keys[ok] & np.uint64((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(ok), np.uint64)
        at = search(lo, hi, want, self._low)
        out[ok[at >= 0]] = at[at >= 0]
        return out


def search(lo: np.ndarray, hi: np.ndarray, want: np.ndarray, value) -> np.ndarray:
    """Where in its own run [lo, hi) of ascending value(places) each number stands, or -1."""
    lo, end, hi = lo.copy(), hi, hi.copy()
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        less = value(mid) < want[todo]
        lo[todo] = np.where(less, mid + 1, lo[todo])
        hi[todo] = np.where(less, hi[todo], mid)
        todo = todo[lo[todo] < hi[todo]]
    out = np.full(len(lo), -1, np.int64)
    here = np.flatnonzero(lo < end)
    hit = here[value(lo[here]) == want[here]]
    out[hit] = lo[hit]
    return out


def packed(numbers: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers in `width` bytes each."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def unpacked(raw: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    """The numbers at these places of `packed`."""
    at = i * width
    out = raw[at].astype(np.uint64)
    for k in range(1, width):
        out |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file, each at a multiple of 64 bytes. A second attempt of a task replaces the file with an equal one."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [str(a.dtype), len(a), at]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(len(text) + 8) // 64) * 64
    parts = [len(text).to_bytes(8, "little") + text + bytes(start - 8 - len(text))]
    for a in arrays.values():
        raw = np.ascontiguousarray(a).tobytes()
        parts.append(raw + bytes(-len(raw) % 64))
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        own = f"{url.path}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(own, "wb") as f:
            f.writelines(parts)
        os.replace(own, url.path)
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as f:
            for p in parts:
                f.write(p)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where it is a path, else read from its store."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        raw = np.memmap(url.path, np.uint8, "r")
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    start = -(-(size + 8) // 64) * 64
    return {k: raw[start + at : start + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in head.items()}
