"""Hashes of the words of whole texts, and counts and lookups by them, with array operations.

Words are runs of anything but ASCII white space, A-Z lower-cased. The hash has 64 bits: of a word of
up to 15 bytes it is a mix of two numbers that consist of the bytes and the length themselves, of
a longer one its XXH3; none is 0. The empty word stands for the end of a text.

Edge cases: a null or empty text has no words; a word never reaches over the end of its text; bytes
outside ASCII, NUL and separators such as U+00A0 are parts of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .subwords import _HIGH, _KEY_BYTES, _LOW, _LOWER, _SPACE, utf8

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33, _56 = np.uint64(33), np.uint64(56)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers, in place."""
    h ^= h >> _33
    h *= _C2
    h ^= h >> _33
    h *= _C3
    h ^= h >> _33
    return h


def _hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = _mixed(high + _C1)
    h ^= low
    return np.maximum(_mixed(h), np.uint64(1))


#: Hash of the empty word.
END = _hashes(np.zeros(1, np.uint64), np.zeros(1, np.uint64))[0]


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and the number of each text's words."""
    import xxhash

    data, at = utf8(column)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(column), np.int64)
    space = _SPACE.take(data)
    first, last = np.empty(len(data), bool), np.empty(len(data), bool)
    np.greater(space[:-1], space[1:], out=first[1:])
    np.less(space[:-1], space[1:], out=last[:-1])
    begin = at[:-1][at[:-1] < at[1:]]  # of the texts that aren't empty
    first[begin] = ~space[begin]
    last[begin - 1] = ~space[begin - 1]  # the first text's is the end of the last
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last)
    sizes -= starts
    sizes += 1
    padded = np.zeros(len(data) + 16, np.uint8)
    _LOWER.take(data, out=padded[: len(data)], mode="clip")
    eights = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
    n = np.minimum(sizes, _KEY_BYTES)
    low, high = eights[starts], eights[starts + 8]
    low &= _LOW.take(n)
    high &= _HIGH.take(n)
    high |= n.astype(np.uint64) << _56
    h = _hashes(low, high)
    long = np.flatnonzero(sizes > _KEY_BYTES)
    if len(long):
        text = padded.tobytes()
        h[long] = [xxhash.xxh3_64_intdigest(text[a : a + m]) or 1 for a, m in zip(starts[long].tolist(), sizes[long].tolist())]
    return h, np.diff(np.searchsorted(starts, at))


class HashTable:
    """Slots of 64-bit hashes by open addressing, at most half of them taken. 0 marks a free slot."""

    def __init__(self, keys: int):
        self.bits = max(10, int(2 * keys).bit_length())
        self.keys, self.held = np.zeros(1 << self.bits, np.uint64), 0

    def clear(self) -> None:
        self.keys[:], self.held = 0, 0

    def find(self, h: np.ndarray, add: bool = False) -> np.ndarray:
        """Slot of each hash; -1 for those that aren't there, unless they are added."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys.take(slot)
        rows = np.flatnonzero(there != h)
        if not len(rows):
            return slot
        h, at, there = h.take(rows), slot.take(rows), there.take(rows)
        while True:
            if add:
                free = there == 0
                self.keys[at[free]] = h[free]  # of several with one slot the last stays
                self.held += len(np.unique(at[free]))
                there = self.keys.take(at)
            done = there == h
            if not add:
                gone = there == 0
                slot[rows[gone]] = -1
                slot[rows[done]] = at[done]
                done |= gone
            else:
                slot[rows[done]] = at[done]
            on = np.flatnonzero(~done)
            if not len(on):
                break
            rows, h, at = rows.take(on), h.take(on), (at.take(on) + 1) & ((1 << self.bits) - 1)
            there = self.keys.take(at)
        return slot
