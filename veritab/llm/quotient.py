"""Counting quotient filters that hold whole keys, so that their counts are exact.

A key of up to 128 bits is permuted by an invertible mixing of its halves. The leading bits, the
quotient, are implied by the slot's place; the rest, the whole remainder, is stored (Pandey et al.,
"A General-Purpose Counting Filter: Making Every Bit Count", 2017). Nothing is lost: a permuted key
is quotient and remainder put together, and the permutation can be undone. Slots are sorted, so
filters are merged like sorted runs.

Within a filter of bytes: the number of slots per quotient in unary, remainders of as many bits as
they need, one bit for slots that count more than one, and these counts.
"""

from __future__ import annotations

import struct

import numpy as np

ROUND_KEYS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
HEAD = struct.Struct("<QBBBQ")


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    """x << by, or x >> -by; 64 places and more leave nothing."""
    if abs(by) >= 64:
        return np.zeros_like(x)
    return x << np.uint64(by) if by >= 0 else x >> np.uint64(-by)


def _mixed(x: np.ndarray, key: int, half: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) & _mask(half)


def permuted(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs of ``half``-bit numbers."""
    for key in ROUND_KEYS:
        high, low = low, high ^ _mixed(low, key, half)
    return high, low


def restored(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Undo ``permuted``."""
    for key in reversed(ROUND_KEYS):
        high, low = low ^ _mixed(high, key, half), high
    return high, low


def half_width(words: int, bits: int) -> int:
    half = (words * bits + 1) // 2
    if half > 64:
        raise ValueError(f"{words} ids of {bits} bits need more than 128 bits")
    return half


def packed_words(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ids side by side, the first in the highest bits, as two halves."""
    half = half_width(len(ids), bits)
    high, low = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
    for i, column in enumerate(ids):
        at, column = bits * (len(ids) - 1 - i), column.astype(np.uint64)
        low |= _shift(column, at) & _mask(half)
        high |= _shift(column, at - half)
    return high, low


def unpacked_words(high: np.ndarray, low: np.ndarray, words: int, bits: int) -> list[np.ndarray]:
    half = half_width(words, bits)
    places = [bits * (words - 1 - i) for i in range(words)]
    return [((_shift(low, -at) | _shift(high, half - at)) & _mask(bits)).astype(np.int64) for at in places]


def _to_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    out, step = [], 1 << 16  # a multiple of 8 rows, so that every part ends with a whole byte
    for i in range(0, len(values), step):
        rows = values[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(rows, axis=1)[:, 64 - width :].ravel()).tobytes())
    return b"".join(out)


def _from_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out, step = np.zeros(n, np.uint64), 1 << 16
    if width:
        for i in range(0, n, step):
            rows = min(step, n - i)
            part = data[i * width // 8 : (i * width + rows * width + 7) // 8]
            wide = np.zeros((rows, 64), np.uint8)
            wide[:, 64 - width :] = np.unpackbits(part, count=rows * width).reshape(rows, width)
            out[i : i + rows] = np.packbits(wide, axis=1).view(">u8").ravel()
    return out


class QuotientFilter:
    """Sorted permuted keys (two halves) and their counts.

    ``implied`` leading bits of the high half are the same in all slots: the number of the shard's
    range, which the caller keeps.
    """

    def __init__(self, half: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        self.half, self.high, self.low, self.counts = half, high, low, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, half: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """From permuted keys in any order; equal ones are added up."""
        if 2 * half <= 64:
            joined = _shift(high, half) | low
            if counts is None:
                joined = np.sort(joined)
            else:
                order = np.argsort(joined, kind="stable")
                joined, counts = joined[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]])) if len(joined) else np.zeros(0, np.int64)
            high, low = _shift(joined[first], -half), joined[first] & _mask(half)
        else:
            order = np.lexsort((low, high))
            high, low, counts = high[order], low[order], None if counts is None else counts[order]
            new = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            first = np.flatnonzero(np.concatenate([[True], new])) if len(high) else np.zeros(0, np.int64)
            joined = high
            high, low = high[first], low[first]
        ends = np.append(first[1:], len(joined)) if len(first) else first
        total = ends - first if counts is None else (np.add.reduceat(counts, first) if len(first) else counts)
        return cls(half, high, low, total.astype(np.int64))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with the sums of the counts; the stable sort merges the runs."""
        columns = [np.concatenate([getattr(f, c) for f in filters]) for c in ("high", "low", "counts")]
        return cls.of(filters[0].half, *columns)

    def ranges(self, bits: int) -> list[tuple[int, QuotientFilter]]:
        """The slots by the leading ``bits`` of the quotient, where there are any."""
        number = _shift(self.high, bits - self.half).astype(np.int64) if bits else np.zeros(len(self), np.int64)
        bounds = np.searchsorted(number, np.arange((1 << bits) + 1))
        return [
            (i, QuotientFilter(self.half, self.high[a:b], self.low[a:b], self.counts[a:b]))
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))
            if b > a
        ]

    def to_bytes(self, implied: int = 0) -> bytes:
        n, left = len(self), self.half - implied
        bits = min(left, max(0, n.bit_length() - 1))  # of the quotient that is stored by place
        rest = left - bits
        high = self.high & _mask(left)
        runs = np.bincount(_shift(high, -rest).astype(np.int64), minlength=1 << bits)
        unary = np.zeros(n + (1 << bits), bool)
        unary[np.cumsum(runs + 1) - 1] = True  # a one closes the run of a quotient
        several = self.counts > 1
        more = self.counts[several]
        long = more > 0xFF
        short = np.where(long, 0, more).astype(np.uint8)
        parts = [
            HEAD.pack(n, self.half, implied, bits, len(more)),
            np.packbits(unary).tobytes(), _to_bits(high & _mask(rest), rest), _to_bits(self.low, self.half),
            np.packbits(several).tobytes(), short.tobytes(), more[long].astype("<i8").tobytes(),
        ]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, number: int = 0) -> QuotientFilter:
        """``number`` is the range, whose bits the filter does not repeat."""
        n, half, implied, bits, n_more = HEAD.unpack_from(data)
        raw, at = np.frombuffer(data, np.uint8), HEAD.size
        rest = half - implied - bits

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return raw[at - size : at]

        unary = np.unpackbits(take((n + (1 << bits) + 7) // 8), count=n + (1 << bits)).astype(bool)
        quotient = np.cumsum(unary)[~unary].astype(np.uint64)
        high = _from_bits(take((n * rest + 7) // 8), n, rest) | _shift(quotient, rest)
        high |= _shift(np.full(n, number, np.uint64), half - implied)
        low = _from_bits(take((n * half + 7) // 8), n, half)
        several = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        more = take(n_more).astype(np.int64)
        long = more == 0
        more[long] = np.frombuffer(take(8 * int(long.sum())).tobytes(), "<i8")
        counts = np.ones(n, np.int64)
        counts[several] = more
        return cls(half, high, low, counts)

    def at_least(self, count: int) -> QuotientFilter:
        kept = self.counts >= count
        return QuotientFilter(self.half, self.high[kept], self.low[kept], self.counts[kept])
