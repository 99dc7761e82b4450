"""A compressed full-text index over sequences of small integers: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a count of ones per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[BitVector, int, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            one = bit.astype(bool)
            self.levels.append((BitVector(bit), int(len(symbols) - one.sum()), level))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def counts_before(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands in front of ``low`` and of ``high``."""
        start = np.zeros(len(symbol), dtype=np.int64)
        for vector, zeros, level in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            places = np.concatenate([start, low, high])
            ones = vector.ones_before(places)
            moved = np.where(np.concatenate([one, one, one]), zeros + ones, places - ones)
            start, low, high = np.split(moved, 3)
        return low - start, high - start


def _dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
    out = np.empty(len(key), dtype=np.int64)
    out[order] = new
    return out, int(new[-1]) + 1 if len(new) else 0


def _joined(rank: np.ndarray, size: int, step: int) -> tuple[np.ndarray, int]:
    """Ranks by three times as many symbols: those at i, i + step and i + 2 * step."""
    shifted = lambda by: np.concatenate([rank[by:] + 1, np.zeros(min(by, len(rank)), dtype=np.int64)])
    if (size + 1) ** 3 < 1 << 62:
        return _dense((rank * (size + 1) + shifted(step)) * (size + 1) + shifted(2 * step))
    pair, n = _dense(rank * (size + 1) + shifted(step))
    return _dense(pair * (size + 1) + shifted(2 * step))


class FMIndex:
    """Index of sequences of at most 26 words; a separator that is unlike any other ends each, so no match runs over it.

    ``seed`` words (9) of a search begin in a table of intervals, the others are read backwards one by one.
    """

    SEED = 9

    def __init__(self, words: np.ndarray, ends: np.ndarray, vocabulary: int):
        """``words``: ids from 1 with 0 as separator at the positions ``ends``."""
        symbols = words + len(ends)
        symbols[ends] = np.arange(len(ends))
        three, n3 = _joined(symbols, len(ends) + vocabulary + 1, 1)
        self.nine, n9 = _joined(three, n3, 3)
        rank, _ = _joined(self.nine, n9, 9)
        self.order = np.argsort(rank, kind="stable")
        bwt = words[self.order - 1]
        counts = np.bincount(words, minlength=vocabulary + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sizes = np.bincount(self.nine, minlength=n9)
        self.seed_low = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.seed_high = self.seed_low + sizes
        self.matrix = WaveletMatrix(bwt, max(1, int(vocabulary + 1).bit_length()))
        self.words = words

    def intervals(self, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array intervals of the patterns of ``length`` words (at least SEED) at ``start`` in the indexed words."""
        seed = self.nine[start + length - self.SEED]
        low, high = self.seed_low[seed], self.seed_high[seed]
        for back in range(length - self.SEED - 1, -1, -1):
            symbol = self.words[start + back]
            low, high = self.matrix.counts_before(symbol, low, high)
            low, high = low + self.first[symbol], high + self.first[symbol]
        return low, high
