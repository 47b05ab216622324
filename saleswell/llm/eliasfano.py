"""Monotone sequences in Elias-Fano form, in flat 64-bit arrays that can be used in place from a mapped file.

A value's low bits lie side by side; its high bits are in unary, one set bit for each
element and one clear bit for each step of the high part, with a count of set bits before every word.
All queries work on arrays of arguments.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE = U(1)


def _words(bits: np.ndarray) -> np.ndarray:
    """A 0/1 array as 64-bit words, lowest bit first, with a spare word."""
    bits = np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, np.uint8)])
    return np.packbits(bits, bitorder="little").view(U)


def encode(values: np.ndarray) -> list[np.ndarray]:
    """[header, low words, high words, set bits before each high word] of a non-decreasing sequence."""
    values = np.asarray(values, U)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    if low:
        bits = np.empty((n, low), np.uint8)
        for b in range(low):
            bits[:, b] = (values >> U(b)) & _ONE
        low_words = _words(bits.reshape(-1))
    else:
        low_words = np.zeros(1, U)
    high = values >> U(low)
    unary = np.zeros(n + (top >> low) + 2, np.uint8)
    unary[(high + np.arange(n, dtype=U)).astype(np.int64)] = 1
    high_words = _words(unary)
    before = np.concatenate([np.zeros(1, U), np.cumsum(np.bitwise_count(high_words), dtype=U)])
    return [np.array([n, low, top], U), low_words, high_words, before]


#: Place of the nth set bit of a byte, at [byte, nth].
_IN_BYTE = np.array([[*(p for p in range(8) if b >> p & 1), *[0] * (8 - b.bit_count())] for b in range(256)], np.uint8).reshape(-1)
_EACH = U(0x0101010101010101)  # 1 in every byte
_TOP = U(0x8080808080808080)


def _nth_set(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Position of the nth (from 0) set bit of each word: set bits up to each byte, then a table for the byte."""
    x = words - ((words >> _ONE) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
    upto = ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _EACH
    shift = np.bitwise_count(((nth * _EACH | _TOP) - upto) & _TOP).astype(U) << U(3)
    nth = nth - (((upto << U(8)) >> shift) & U(255))
    return shift + _IN_BYTE[(((words >> shift) & U(255)) << U(3)) | nth]


class EliasFano:
    def __init__(self, arrays: list[np.ndarray]):
        header, self.low_words, self.high_words, self.before = arrays
        self.n, self.low, self.top = (int(x) for x in header)
        self.clear_before = (np.arange(len(self.before), dtype=U) << U(6)) - self.before

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U)
        bit = i.astype(U) * U(self.low)
        word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        value = self.low_words[word] >> shift
        value |= np.where(shift > 0, self.low_words[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return value & U((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions i."""
        i = i.astype(U)
        word = np.searchsorted(self.before, i, side="right") - 1
        bit = (U(64) * word.astype(U)) + _nth_set(self.high_words[word], i - self.before[word])
        return ((bit - i) << U(self.low)) | self._low(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """First position whose high part is >= high."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        nth = high[some] - _ONE  # the clear bit that ends the bucket before
        word = np.searchsorted(self.clear_before, nth, side="right") - 1
        bit = (U(64) * word.astype(U)) + _nth_set(~self.high_words[word], nth - self.clear_before[word])
        out[some] = (bit - nth).astype(np.int64)
        return out

    def _bucket_end(self, high: np.ndarray, first: np.ndarray) -> np.ndarray:
        """First position beyond the elements that share a high part, whose first one is known."""
        bit = first.astype(U) + high
        shift = bit & U(63)
        rest = self.high_words[(bit >> U(6)).astype(np.int64)] >> shift
        ones = np.bitwise_count(rest & ~(rest + _ONE)).astype(U)  # set bits before the next clear one
        out = first + ones.astype(np.int64)
        over = np.flatnonzero(shift + ones >= U(64))
        out[over] = self._bucket(high[over] + _ONE)
        return out

    def successor(self, values: np.ndarray) -> np.ndarray:
        """First position whose element is >= value (n if none)."""
        return self.search(values, 0, self.n)[0]

    def search(self, values: np.ndarray, first: np.ndarray | int, last: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """First position in [first, last) whose element is >= value (last if none), and whether it equals the value."""
        values = values.astype(U)
        over = values > U(self.top)
        high = np.where(over, U(0), values >> U(self.low))
        a = self._bucket(high)
        end = self._bucket_end(high, a)
        b = end.copy()
        part = values & U((1 << self.low) - 1)
        while True:  # bisect the low parts of the bucket
            go = np.flatnonzero(a < b)
            if len(go) == 0:
                break
            mid = (a[go] + b[go]) // 2
            less = self._low(mid) < part[go]
            a[go[less]], b[go[~less]] = mid[less] + 1, mid[~less]
        a[over] = self.n
        same = np.zeros(len(a), bool)
        inside = np.flatnonzero((a < end) & ~over)
        same[inside] = self._low(a[inside]) == part[inside]
        return np.clip(a, first, last), same & (a >= first) & (a < last)
