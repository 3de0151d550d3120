"""Elias-Fano sequences in memory-mapped words, searched for many values at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: All bytes 1, and all bytes' top bits.
ONES, TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: Where the r-th (from 0) set bit of a byte is.
SELECT = np.array([[([b for b in range(8) if byte >> b & 1] + [8] * 8)[r] for r in range(8)] for byte in range(256)], np.uint8)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width integers end to end in 64-bit words, and one word more."""
    out = np.zeros((len(values) * width + 63) // 64 + 2, U)
    if width and len(values):
        at = np.arange(len(values), dtype=U) * U(width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        # words of neighbouring values overlap: bits are disjoint, so sums are unions
        np.add.at(out, word, values << shift)
        over = np.flatnonzero(shift.astype(np.int64) + width > 64)
        np.add.at(out, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return out


def unpack_bits(words: np.ndarray, width: int, k: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(k), U)
    at = k.astype(U) * U(width)
    word, shift = (at >> U(6)).astype(np.int64), at & U(63)
    low = words[word] >> shift
    high = np.where(shift > U(0), words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return (low | high) & U((1 << width) - 1)


def encode(values: np.ndarray, sought: bool = True) -> dict:
    """Arrays and sizes of an ascending uint64 sequence: above its first, low bits packed, high bits in unary, and how many
    zeros stand before each word of these where values are ``sought`` by :meth:`EliasFano.find`, ones where they are read by place."""
    base = int(values[0]) if len(values) else 0
    values = values - U(base)
    bits = int(values[-1]).bit_length() if len(values) else 0
    n = len(values)
    low = max(0, min(63, bits - max(0, (max(1, n) - 1).bit_length())))
    high = (values >> U(low)).astype(np.int64)
    buckets = int(high[-1]) + 1 if n else 1
    ones = high + np.arange(n)
    size = buckets + n
    raw = np.zeros((size + 63) // 64 * 64 + 128, bool)
    raw[ones] = True
    high = np.packbits(raw, bitorder="little").view(U)
    ones = np.bitwise_count(high).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(64 - ones if sought else ones)[:-1]))
    return {"base": base, "n": n, "low_bits": low, "buckets": buckets, "low": pack_bits(values & U((1 << low) - 1), low), "high": high, "before": before.astype(np.uint32 if size < 1 << 32 else np.int64)}


def select_in_words(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Where the r-th (from 0) set bit of each word is: its byte by running counts of all eight at once, then by table."""
    n = words - ((words >> U(1)) & U(0x5555555555555555))
    n = (n & U(0x3333333333333333)) + ((n >> U(2)) & U(0x3333333333333333))
    n = ((n + (n >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * ONES  # each byte: the bits in it and below
    full = ((((r * ONES) | TOPS) - n) & TOPS) >> U(7)  # bytes that end before it
    at = (full * ONES) >> U(56) << U(3)
    left = r - ((n << U(8)) >> at & U(255))
    return at.astype(np.int64) + SELECT[(words >> at & U(255)).astype(np.int64), left.astype(np.int64)]


class EliasFano:
    def __init__(self, base: int, n: int, low_bits: int, buckets: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.base, self.n, self.low_bits, self.buckets, self.low, self.high, self.before = base, n, low_bits, buckets, low, high, before

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) zero among the high bits, however long the runs of ones: its word by the counts, then its bit."""
        word = np.searchsorted(self.before, k.astype(self.before.dtype), side="right") - 1
        return (word << 6) + select_in_words(~self.high[word], (k - self.before[word]).astype(U))

    def _one(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) one among the high bits."""
        word = np.searchsorted(self.before, k.astype(self.before.dtype), side="right") - 1
        return (word << 6) + select_in_words(self.high[word], (k - self.before[word]).astype(U))

    def _value(self, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        high = (at - k).astype(U) << U(self.low_bits)
        return (high | unpack_bits(self.low, self.low_bits, k) if self.low_bits else high) + U(self.base)

    def access(self, k: np.ndarray) -> np.ndarray:
        """The values at places ``k`` of a sequence that was encoded to be read by place."""
        return self._value(k, self._one(k))

    def bounds(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places ``k`` and at the places after them: of pointers, the range that each names. The next one mostly stands in the same word."""
        at = self._one(k)
        rest = self.high[at >> 6] >> (at & 63).astype(U) >> U(1)
        after = at + 1 + np.bitwise_count((rest & (~rest + U(1))) - U(1))
        far = np.flatnonzero(rest == 0)
        after[far] = self._one(k[far] + 1)
        return self._value(k, at).astype(np.int64), self._value(k + 1, after).astype(np.int64)

    def find(self, values: np.ndarray, within: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Index of each value, -1 where it is not there: its successor is sought by halves, in its bucket and, if given, ``within`` a range of places."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values - U(self.base)  # what is below the base wraps round, beyond the last bucket
        high = values >> U(self.low_bits)
        todo = np.flatnonzero(high < U(self.buckets))
        high, low = high[todo].astype(np.int64), values[todo] & U((1 << self.low_bits) - 1)
        later = np.flatnonzero(high > 0)
        at = np.zeros(len(todo), np.int64)
        at[later] = self._zero(high[later] - 1) + 1
        lo = at - high
        # the bucket is the run of ones from there; only a run that leaves its word needs the next zero
        bit = at & 63
        stop = ~(self.high[at >> 6] >> bit.astype(U))
        run = np.bitwise_count((stop & (~stop + U(1))) - U(1)).astype(np.int64)
        hi = lo + run
        far = np.flatnonzero(bit + run >= 64)
        hi[far] = self._zero(high[far]) - high[far]
        if within is not None:
            lo, hi = np.maximum(lo, within[0][todo]), np.minimum(hi, within[1][todo])
        end = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = unpack_bits(self.low, self.low_bits, mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        there = np.flatnonzero(lo < end)
        there = there[unpack_bits(self.low, self.low_bits, lo[there]) == low[there]]
        out[todo[there]] = lo[there]
        return out
