"""Elias-Fano sequences and flat files of arrays that are mapped into memory."""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

from . import common

U = np.uint64
MAGIC = b"SGARRAY1"


def write_arrays(path: str, arrays: dict[str, np.ndarray], facts: dict) -> None:
    """Arrays at 64-byte bounds after a JSON header, in a file of the shared folder."""
    head, at = {"facts": facts, "arrays": {}}, 0
    for name, a in arrays.items():
        head["arrays"][name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(16 + len(text)) % 64)
    common.write_file(path, chain([MAGIC + len(text).to_bytes(8, "little") + text], *((a.tobytes(), bytes(-a.nbytes % 64)) for a in arrays.values())))


def read_arrays(path: str) -> tuple[dict[str, np.ndarray], dict] | None:
    """The arrays and facts of a file; None if there is no such file."""
    data = common.mapped(path)
    if data is None:
        return None
    if data[:8].tobytes() != MAGIC:
        raise ValueError(f"{path} holds no arrays")
    n = int.from_bytes(data[8:16].tobytes(), "little")
    head = json.loads(data[16 : 16 + n].tobytes())
    start = -(-(16 + n) // 64) * 64
    out = {}
    for name, (kind, length, at) in head["arrays"].items():
        size = np.dtype(kind).itemsize * length
        out[name] = np.asarray(data[start + at : start + at + size]).view(kind)
    return out, head["facts"]


#: The place of the k-th one of a byte, at k << 8 | byte.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for k in range(8) for byte in range(256)], np.int64)


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) of each word: by the ones up to each byte, then inside the byte."""
    s = word - (word >> U(1) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + (s >> U(2) & U(0x3333333333333333))
    s = (s + (s >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * U(0x0101010101010101)
    k = k.astype(U)
    full = ((k * U(0x0101010101010101) | U(0x8080808080808080)) - s) & U(0x8080808080808080)
    place = np.minimum(np.bitwise_count(full), 7).astype(U) * U(8)
    inside = (k - (s << U(8) >> place & U(255))) & U(7)
    return place.astype(np.int64) + _IN_BYTE[inside << U(8) | word >> place & U(255)]


class EliasFano:
    """A strictly or weakly increasing sequence in about 2 + log2(universe / n) bits a value.

    The low bits stand packed; the high ones in unary, with the ones and zeros before each word counted for select.
    """

    def __init__(self, arrays: dict[str, np.ndarray], name: str, n: int, low_bits: int):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.ones, self.zeros = (arrays[f"{name}.{x}"] for x in ("low", "high", "ones", "zeros"))

    @staticmethod
    def build(values: np.ndarray) -> tuple[dict[str, np.ndarray], list[int]]:
        """The arrays (low, high, ones, zeros) and [n, low bits]."""
        values = values.astype(U)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = np.zeros(n * low_bits + 128, np.uint8)
        for i in range(low_bits):
            bits[i : n * low_bits : low_bits] = (values >> U(i)).astype(np.uint8) & 1
        low = np.packbits(bits[: len(bits) // 64 * 64], bitorder="little").view("<u8")
        upper = np.zeros(((n + (universe >> low_bits) + 2) // 64 + 1) * 64, np.uint8)
        upper[(values >> U(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(upper, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]))
        return {"low": low, "high": high, "ones": ones.astype("<u4"), "zeros": (np.arange(len(high)) * 64 - ones).astype("<u4")}, [n, low_bits]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift | self.low[word + 1] << U(1) << (U(63) - shift)
        return value & U((1 << self.low_bits) - 1)

    def bits(self, at: np.ndarray) -> np.ndarray:
        """64 upper bits from each place on."""
        word, shift = at >> 6, (at & 63).astype(U)
        return self.high[word] >> shift | self.high[np.minimum(word + 1, len(self.high) - 1)] << U(1) << (U(63) - shift)

    def place(self, i: np.ndarray) -> np.ndarray:
        """Where the i-th one stands in the upper bits."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        return word * 64 + select_in_word(self.high[word], i - self.ones[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        return ((self.place(i) - i).astype(U) << U(self.low_bits) | self.lows(i)).astype(np.int64)

    def access_pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at these places, and at those after them: the next one is mostly in sight."""
        at = self.place(i)
        later = self.bits(at + 1)
        next_ = at + 1 + np.bitwise_count((later & (~later + U(1))) - U(1))
        far = np.flatnonzero(later == 0)
        next_[far] = self.place(i[far] + 1)
        value = lambda place, k: ((place - k).astype(U) << U(self.low_bits) | self.lows(k)).astype(np.int64)
        return value(at, i), value(next_, i + 1)

    def zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero in the upper bits."""
        word = np.searchsorted(self.zeros, k.astype(np.uint32), side="right") - 1
        return word * 64 + select_in_word(~self.high[word], k - self.zeros[word])

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        h = values >> self.low_bits
        inside = np.flatnonzero((values >= 0) & (h < int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1]))))
        h, want = h[inside], (values[inside] & ((1 << self.low_bits) - 1)).astype(U)
        start = np.where(h > 0, self.zero(np.maximum(h - 1, 0)) + 1, 0)
        left = start - h
        # The values that share their high bits are a run of ones.
        gaps = ~self.bits(start)
        right = left + np.bitwise_count((gaps & (~gaps + U(1))) - U(1))
        long = np.flatnonzero(gaps == 0)
        right[long] = self.zero(h[long]) - h[long]
        last, todo = right.copy(), np.flatnonzero(left < right)
        while len(todo):
            middle = (left[todo] + right[todo]) >> 1
            less = self.lows(middle) < want[todo]
            left[todo[less]], right[todo[~less]] = middle[less] + 1, middle[~less]
            todo = todo[left[todo] < right[todo]]
        some = np.flatnonzero(left < last)
        hit = some[self.lows(left[some]) == want[some]]
        out[inside[hit]] = left[hit]
        return out
