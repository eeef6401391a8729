"""Elias-Fano sequences over numpy buffers: monotone integers in about 2 + log2(universe / n) bits each."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


def bundle(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; the bytes of equal weight stand together."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        packed = pa.compress(raw, codec=_CODEC, asbytes=True)
        out += [struct.pack("<4sQQ", a.dtype.str[1:].encode().ljust(4), len(a), len(packed)), packed]
    return b"".join(out)


def unbundle(blob: bytes) -> list[np.ndarray]:
    (count,), at, out = struct.unpack_from("<I", blob), 4, []
    for _ in range(count):
        kind, length, size = struct.unpack_from("<4sQQ", blob, at)
        at += 20
        dtype = np.dtype(kind.decode().strip())
        raw = pa.decompress(blob[at : at + size], length * dtype.itemsize, codec=_CODEC, asbytes=True)
        planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, length) if length else np.empty((dtype.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(length))
        at += size
    return out


def smallest(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the narrowest type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


class Bits:
    """A bit vector with select of ones and zeros; the counts by word are made when it is opened."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = [np.concatenate([[0], np.cumsum(x)]) for x in (64 - ones, ones)]

    def select(self, which: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the which-th (from 0) set or clear bit; of many, by one pass over all bits."""
        if len(which) > 16 * len(self.words):
            bits = np.unpackbits(self.words.view(np.uint8), bitorder="little")
            return np.flatnonzero(bits == one)[which]
        before = self.before[one]
        word = np.searchsorted(before, which, side="right") - 1
        left = which - before[word]
        bits = self.words[word] if one else ~self.words[word]
        place = np.zeros(len(which), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << step) - 1)
            inside = np.bitwise_count(low).astype(np.int64)
            beyond = left >= inside
            left = left - np.where(beyond, inside, 0)
            bits = np.where(beyond, bits >> np.uint64(step), low)
            place += np.where(beyond, step, 0)
        return word * 64 + place


class EliasFano:
    """Non-decreasing integers below 2**62: low bits packed, high bits in unary."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.size, self.low_bits, self.low = size, low_bits, low
        self.high = Bits(high)
        self.buckets = int(self.high.before[0][-1])

    @staticmethod
    def parts(values: np.ndarray) -> list[np.ndarray]:
        """The arrays to store: (size, low bits), packed low bits, unary high bits."""
        values = np.asarray(values, np.uint64)
        top = int(values[-1]) + 1 if len(values) else 1
        width = max(0, (top // max(len(values), 1)).bit_length() - 1)
        lows = values & np.uint64((1 << width) - 1)
        planes = np.ascontiguousarray(lows, "<u8").view(np.uint8).reshape(len(lows), 8)
        bits = np.unpackbits(planes, axis=1, count=width, bitorder="little") if width else planes[:, :0]
        low = np.append(np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8))
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(len(values))
        unary = np.zeros(((len(values) + (top >> width) + 1) // 64 + 1) * 64, np.uint8)
        unary[ones] = 1
        return [np.array([len(values), width], np.int64), low, np.packbits(unary, bitorder="little").view(np.uint64)]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        window = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))
        return (window[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        high = self.high.select(at, True) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value's first occurrence, -1 where it has none: a search in the bucket of its high bits."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        asked = np.flatnonzero(high < self.buckets) if self.size else np.empty(0, np.int64)
        high, want = high[asked], values[asked] & np.uint64((1 << self.low_bits) - 1)
        start = np.where(high > 0, self.high.select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = np.minimum(self.high.select(high, False) - high, self.size)
        low, top = start.copy(), end.copy()
        open_ = np.flatnonzero(low < top)
        while len(open_):
            middle = (low[open_] + top[open_]) // 2
            less = self._low(middle) < want[open_]
            low[open_[less]], top[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[low[open_] < top[open_]]
        hit = low < end
        hit[hit] = self._low(low[hit]) == want[hit]
        out[asked[hit]] = low[hit]
        return out
