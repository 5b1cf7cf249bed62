"""Elias-Fano coded monotone sequences over numpy arrays, with vectorised access and successor search.

A sequence of n values below u keeps the low l = log2(u / n) bits of each value packed, and the high parts in unary
in a bit vector: value i sets bit (high + i). Ones and zeros of the vector are selected through the ones before each
64-bit word and sums of bytes within it, so an access reads one word and a successor search two words and the few
values of one high part.
All arrays may be memory maps.
"""

from __future__ import annotations

import io

import numpy as np

_BITS = 64
_U = np.uint64
_ONES, _HIGHS = _U(0x0101010101010101), _U(0x8080808080808080)
_SELECT8 = np.zeros((256, 8), dtype=np.int64)  # place of the k-th one of a byte
for _x in range(256):
    _ones = [b for b in range(8) if _x >> b & 1]
    _SELECT8[_x, : len(_ones)] = _ones


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) of each 64-bit word, which must have that many."""
    with np.errstate(over="ignore"):
        s = word - ((word >> _U(1)) & _U(0x5555555555555555))
        s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
        sums = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # ones up to and with each byte
        place = np.bitwise_count(((k * _ONES | _HIGHS) - sums) & _HIGHS).astype(np.uint64) * _U(8)
        rest = k - ((sums << _U(8)) >> place & _U(0xFF))
        return place.astype(np.int64) + _SELECT8[(word >> place & _U(0xFF)).astype(np.int64), rest.astype(np.int64)]


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of `bits` bits each, one after another in 64-bit words (one word more than they fill)."""
    n = len(values)
    out = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
    if bits and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def read_bits(packed: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    """The i-th values of pack_bits."""
    if not bits:
        return np.zeros(len(i), dtype=np.uint64)
    at = i.astype(np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = packed[word] >> shift
    high = np.where(shift > 0, packed[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << bits) - 1)


class EliasFano:
    """A monotone (not necessarily strictly) sequence of unsigned 64-bit values."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * _BITS - ones.astype(np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = pack_bits(values & np.uint64((1 << bits) - 1), bits)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) if n else 0) + 2
        flags = np.zeros((size // _BITS + 1) * _BITS, dtype=np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        many = np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.cumsum(many) - many)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.bits], dtype=np.int64), "low": self.low, "high": self.high, "ones": self.ones}

    @classmethod
    def from_arrays(cls, a: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(a["head"][0]), int(a["head"][1]), a["low"], a["high"], a["ones"])

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        at = np.searchsorted(before, k, side="right") - 1
        word = self.high[at]
        return at * _BITS + select_in_word(~word if flip else word, (k - before[at]).astype(np.uint64))

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, dtype=np.int64)
        high = (self._select(i, self.ones, False) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | read_bits(self.low, self.bits, i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether it is x itself); the place is n if there is none."""
        x = np.asarray(x, dtype=np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        last = int(self.get(np.array([self.n - 1]))[0])
        beyond = x > np.uint64(last)
        part = np.where(beyond, np.uint64(last), x)
        h = (part >> np.uint64(self.bits)).astype(np.int64)
        want = part & np.uint64((1 << self.bits) - 1)
        low = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) - (h - 1), 0)
        high = self._select(h, self.zeros, True) - h
        stop = high.copy()
        while True:  # binary search among the values of one high part
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            less = read_bits(self.low, self.bits, middle) < want[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        same = np.zeros(len(x), dtype=bool)
        inside = np.flatnonzero((low < stop) & ~beyond)
        same[inside] = read_bits(self.low, self.bits, low[inside]) == want[inside]
        return np.where(beyond, self.n, low), same


def save(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one blob: a JSON line of names, types and places, then the arrays at multiples of 64 bytes."""
    import json

    plan, at = {}, 0
    for k, v in arrays.items():
        plan[k] = (v.dtype.str, len(v), at)
        at += -(-v.nbytes // 64) * 64
    head = json.dumps(plan).encode()
    start = -(-(len(head) + 8) // 64) * 64
    out = io.BytesIO()
    out.write(len(head).to_bytes(8, "little") + head)
    for k, v in arrays.items():
        out.seek(start + plan[k][2])
        out.write(np.ascontiguousarray(v).tobytes())
    out.seek(start + at)
    return out.getvalue() + b"\0" * max(0, start + at - len(out.getvalue()))


def load(uri: str) -> dict[str, np.ndarray]:
    """Arrays of a saved file: memory-mapped on a mounted shared folder, read from any other store."""
    import json
    import os

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem) and os.path.exists(path):
        data = np.memmap(path, dtype=np.uint8, mode="r")
    else:
        with store.open_input_stream(path) as f:
            data = np.frombuffer(f.read(), dtype=np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    plan = json.loads(data[8 : 8 + size].tobytes())
    start = -(-(size + 8) // 64) * 64
    return {k: data[start + at : start + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in plan.items()}
