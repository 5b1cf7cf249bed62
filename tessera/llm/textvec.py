"""Vectorised words and word hashes over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes outside a separator set; it never crosses two texts. Its 64-bit hash is a
tabulated polynomial over its bytes, taken from prefix sums modulo 2**64 and mixed, so no Python string is made
for a word. Two words of equal hash are taken as equal where an operator says so; elsewhere bytes are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return z ^ (z >> np.uint64(32))


#: Bytes that are hashed at a time; a longer single word is a span of its own.
SPAN_BYTES = 4 << 20
_TABLE = _splitmix(256, 7)
_BASE = 0xA24BAED4963EE407  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            out = np.cumprod(out, dtype=np.uint64)
        if size > 1 << 23:  # a very long text: not kept
            return out
        _powers[base] = have = out
    return have


def forget() -> None:
    """Drops the kept powers."""
    _powers.clear()


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, True in the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: [\x20\x09-\x0D]
WHITE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: [\x00-\x2F\x3A-\x60\x7B-\x7F], to be used on lower-cased text
NOT_WORD = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a run of texts: byte positions, hashes and the first word of each text."""

    data: np.ndarray  # bytes of all texts, lower-cased if asked
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n texts + 1
    text_start: np.ndarray  # n texts + 1

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())


def raw_bytes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and n + 1 offsets into them."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=texts.offset * 8)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, a: int, most: int) -> int:
    """The end of a span from a on that cuts no word: at most `most` bytes long, or as long as its one word asks for."""
    n = len(data)
    low, high = a, min(n, a + most)
    while high < n:
        between = np.flatnonzero(separators[data[low:high]])
        text = int(offsets[np.searchsorted(offsets, high, side="right") - 1])
        at = max(text, low + int(between[-1]) + 1 if len(between) else 0)
        if at > a:
            return at
        low, high = high, min(n, high + most)
    return n


def words(texts: pa.LargeStringArray, separators: np.ndarray, lower: bool = False) -> Words:
    """Words of each text, in order. The arrays besides a byte and the words themselves are of one span at a time, so a
    very long text takes little more than its own size."""
    data, offsets = raw_bytes(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    starts, ends, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    a = 0
    while a < n:
        b = _cut(data, offsets, separators, a, SPAN_BYTES)
        start, end, code = _words_of(data[a:b], offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a, separators)
        starts.append(start + a)
        ends.append(end + a)
        codes.append(code)
        a = b
    start, end, code = (x[1] if len(x) == 2 else np.concatenate(x) for x in (starts, ends, codes))
    return Words(data, start, end, code, np.searchsorted(start, offsets), offsets)


def _words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a span; texts begin at offsets."""
    n = len(data)
    inside = ~separators[data]
    fresh = np.zeros(n + 1, dtype=bool)  # a text begins here
    fresh[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | fresh[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * _power(_BASE, n)[:n], dtype=np.uint64, out=sums[1:])
        code = (sums[end] - sums[start]) * _power(_INVERSE, n)[start]
        code = mix64(code + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return start, end, code


def combine(*columns: np.ndarray) -> np.ndarray:
    """One hash of several hash columns, by order."""
    with np.errstate(over="ignore"):
        out = mix64(columns[0] + np.uint64(0x51AFD7ED558CCD00))
        for c in columns[1:]:
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + c)
    return out
