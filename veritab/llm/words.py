"""Vector helpers over many texts at once: word bounds, word hashes, ragged gathers, a hash table.

A batch of texts becomes one array of code points. A word is a run between two bounds; its hash
is a polynomial over its code points modulo 2**64, taken from one running sum over the batch, so
that no Python code runs per word. Memory follows the batch, see ``chunks``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled at once; a longer text is handled alone.
CHUNK = 1_000_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The White_Space property of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The six bytes that the contract counts as white space.
ASCII_WHITE = [0x20, *range(0x09, 0x0E)]
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``most`` code points; whole texts only."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, list[str]]]:
    """The same ranges of an Arrow text column with their texts; only one range is taken out at a time.

    A null text counts as empty.
    """
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(sizes):
        inside = int(np.searchsorted(np.cumsum(sizes[start:]), most, side="right"))
        stop = start + max(1, inside)
        yield start, stop, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text starts, with the total as the last entry."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer(joined, np.uint32), starts


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)),
        np.uint8,
        sys.maxunicode + 1,
    )
    table[WHITE] = SPACE
    return table


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _size(n: int) -> int:
    return 1 << max(20, int(n).bit_length())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of points[start:end] for every word."""
    n = len(points)
    total = np.zeros(n + 1, np.uint64)
    spread = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(32)
    np.cumsum(spread * _powers(int(BASE), _size(n))[:n], out=total[1:])
    shifted = (total[end] - total[start]) * _powers(int(BASE_INVERSE), _size(n))[start]
    return mix(shifted + (end - start).astype(np.uint64) * BASE)


def ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices pool[start:start+length], one after the other."""
    length = length.astype(np.int64)
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    index = np.arange(ends[-1]) + np.repeat(start.astype(np.int64) - (ends - length), length)
    return pool[index]


class Table:
    """Open addressing from 64-bit hashes to row numbers, for whole arrays at a time.

    It holds at most half of ``2**bits`` keys; ``full`` says when the next keys don't fit and the
    owner should start a new one, which bounds the memory of a worker.
    """

    def __init__(self, bits: int):
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        self.mask = np.uint64((1 << bits) - 1)
        self.used = 0

    def full(self, more: int) -> bool:
        return 2 * (self.used + more) > len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of every hash, -1 where it is unknown."""
        slot = (hashes & self.mask).astype(np.int64)
        row = self.rows[slot]
        todo = np.flatnonzero((row >= 0) & (self.keys[slot] != hashes))
        while len(todo):
            at = (slot[todo] + 1) & int(self.mask)
            slot[todo] = at
            row[todo] = found = self.rows[at]
            todo = todo[(found >= 0) & (self.keys[at] != hashes[todo])]
        return row

    def add(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """``hashes`` are distinct and unknown."""
        slot = (hashes & self.mask).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            at = slot[todo]
            free = todo[self.rows[at] < 0]
            self.rows[slot[free]] = rows[free]  # of several the last stays
            won = free[self.rows[slot[free]] == rows[free]]
            self.keys[slot[won]] = hashes[won]
            lost = np.ones(len(hashes), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slot[todo] = (slot[todo] + 1) & int(self.mask)
        self.used += len(hashes)
