"""Elias-Fano sequences over numpy words, and the flat files they are mapped from."""

from __future__ import annotations

import json
import mmap
import os
import posixpath
import tempfile
import uuid

import numpy as np
from pyarrow import fs

ONE = np.uint64(1)
#: Place of the r-th set bit of a byte, at [byte * 8 + r].
_PLACE = np.array([[*(i for i in range(8) if b >> i & 1), *[0] * (8 - b.bit_count())] for b in range(256)], np.int64).ravel()


def _select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for s in (32, 16, 8):
        low = x & np.uint64((1 << s) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = r >= ones
        r = np.where(up, r - ones, r)
        x = np.where(up, x >> np.uint64(s), low)
        at += s * up
    return at + _PLACE[(x & np.uint64(255)).astype(np.int64) * 8 + r]


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(1, np.uint64)
    rows = -(-len(values) // 64)
    v = np.zeros((rows, 64), np.uint64)
    v.ravel()[: len(values)] = values
    out = np.zeros((rows, bits), np.uint64)
    for j in range(64):
        w, off = divmod(j * bits, 64)
        out[:, w] |= v[:, j] << np.uint64(off)
        if off + bits > 64:
            out[:, w + 1] |= v[:, j] >> np.uint64(64 - off)
    return np.append(out.ravel(), np.uint64(0))


class EliasFano:
    """A non-decreasing sequence of numbers below 2^64: low bits packed, high bits in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack(values & np.uint64((1 << bits) - 1), bits)
        up = (values >> np.uint64(bits)).astype(np.int64)
        size = n + (top >> bits) + 2
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[up + np.arange(n)] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        return cls(n, bits, low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        p = i * self.bits
        w, off = p >> 6, (p & 63).astype(np.uint64)
        x = self.low[w] >> off
        # a shift by 64 in two steps, for where the value starts a word
        x |= (self.low[w + 1] << (np.uint64(63) - off)) << ONE
        return x & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        ones = 64 * np.arange(len(self.zeros), dtype=np.int64) - self.zeros
        w = np.searchsorted(ones, i, side="right") - 1
        p = 64 * w + _select_in_word(self.high[w], i - ones[w])
        return ((p - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def all(self) -> np.ndarray:
        """The whole sequence, decoded in one go: where many elements are asked for, that costs less than as many selects."""
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        return high.astype(np.uint64) << np.uint64(self.bits) | self._low(np.arange(self.n))

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many elements have high bits below ``h``: the place of the zero numbered h - 1, less the zeros up to it."""
        k = np.maximum(h - 1, 0)
        w = np.searchsorted(self.zeros, k, side="right") - 1
        at = 64 * w + _select_in_word(~self.high[w], k - self.zeros[w])
        return np.where(h > 0, at - k, 0)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element >= x (n if none), and whether it equals x.

        The unary part gives the run of elements that share x's high bits; the
        low bits are searched in that run by halving.
        """
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = x >> np.uint64(self.bits)
        past = h >= np.uint64(self.zeros[-1])
        h = np.where(past, 0, h).astype(np.int64)
        i = np.where(past, self.n, self._before(h))
        end = np.where(past, self.n, self._before(np.minimum(h + 1, self.zeros[-1])))
        low = x & np.uint64((1 << self.bits) - 1)
        last = end.copy()
        active = np.flatnonzero(i < end)
        while len(active):
            a, b = i[active], end[active]
            m = (a + b) >> 1
            smaller = self._low(m) < low[active]
            a, b = np.where(smaller, m + 1, a), np.where(smaller, b, m)
            i[active], end[active] = a, b
            active = active[a < b]
        equal = np.zeros(len(x), bool)
        inside = np.flatnonzero(i < last)
        equal[inside] = self._low(i[inside]) == low[inside]
        return i, equal

    def parts(self, name: str) -> tuple[dict, dict[str, np.ndarray]]:
        return {name: [self.n, self.bits]}, {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, meta: dict, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        return cls(*meta[name], *(arrays[f"{name}.{k}"] for k in ("low", "high", "zeros")))


def write_flat(uri: str, meta: dict, arrays: dict[str, np.ndarray]) -> None:
    """Header and arrays in one file, written under a temporary name and then moved."""
    store, path = fs.FileSystem.from_uri(uri)
    at, table = 0, {}
    for k, a in arrays.items():
        table[k] = [str(a.dtype), len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"meta": meta, "arrays": table}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    tmp = posixpath.join(posixpath.dirname(path), f".tmp-{uuid.uuid4().hex}")
    with store.open_output_stream(tmp) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    store.move(tmp, path)


def remove_flat(uri: str) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    store.delete_file(path)


def map_flat(uri: str) -> tuple[dict, dict[str, np.ndarray]]:
    """The file's arrays, memory-mapped. From a store that is no folder here it is
    first copied to a nameless local file, which ends with the mapping."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, store.open_input_stream(path) as src:
            while chunk := src.read(1 << 24):
                f.write(chunk)
            f.flush()
            os.fsync(f.fileno())
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + size])
    base = 8 + size
    return head["meta"], {k: np.frombuffer(data, np.dtype(kind), n, base + at) for k, (kind, n, at) in head["arrays"].items()}
