"""Elias-Fano sequences and a two-level n-gram trie over them; every level reads from a buffer or a mapped file."""

from __future__ import annotations

import struct

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
POPCOUNT = _BITS.sum(axis=1).astype(np.uint8)
#: Place of the k-th one of a byte.
SELECT = np.array([[*np.flatnonzero(row), *[8] * (8 - int(row.sum()))] for row in _BITS], dtype=np.int64)


def select_in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each 64-bit word."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(POPCOUNT[parts], axis=1, dtype=np.int64)
    byte = (upto <= k[:, None]).sum(axis=1)
    rows = np.arange(len(words))
    before = upto[rows, byte] - POPCOUNT[parts[rows, byte]]
    return 8 * byte + SELECT[parts[rows, byte], k - before]


class EliasFano:
    """A monotone sequence: low bits packed, high parts as unary gaps, read by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones)])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = np.zeros(((top >> bits) + n) // 64 + 1, dtype=np.uint64)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits:
            part, at = values & np.uint64((1 << bits) - 1), np.arange(n) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(n, bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        above = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> shift | above) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = 64 * word + select_in_words(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _from(self, part: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``part``."""
        out = np.full(len(part), self.n, dtype=np.int64)
        out[part == 0] = 0
        asked = np.flatnonzero((part > 0) & (part <= self.zeros[-1]))
        k = part[asked] - 1
        word = np.searchsorted(self.zeros, k, side="right") - 1
        place = 64 * word + select_in_words(~self.high[word], k - self.zeros[word])
        out[asked] = np.minimum(place - k, self.n)
        return out

    def successor(self, target: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each target between ``first`` and ``end`` (behind), or -1 where its successor there is another value."""
        out = np.full(len(target), -1, dtype=np.int64)
        part, low = (target >> np.uint64(self.low_bits)).astype(np.int64), target & np.uint64((1 << self.low_bits) - 1)
        at = np.maximum(self._from(part), first)
        stop = np.minimum(self._from(part + 1), end)
        live = np.flatnonzero(at < stop)
        while len(live):
            value = self._low(at[live])
            hit = value == low[live]
            out[live[hit]] = at[live[hit]]
            at[live] += 1
            live = live[(value < low[live]) & (at[live] < stop[live])]
        return out

    def parts(self) -> list[bytes]:
        head = struct.pack("<qqqq", self.n, self.low_bits, len(self.low), len(self.high))
        return [head, np.ascontiguousarray(self.low).tobytes(), np.ascontiguousarray(self.high).tobytes()]

    @classmethod
    def read(cls, buffer, at: int) -> tuple[EliasFano, int]:
        n, bits, low, high = struct.unpack_from("<qqqq", buffer, at)
        at += 32
        lows = np.frombuffer(buffer, dtype=np.uint64, count=low, offset=at)
        highs = np.frombuffer(buffer, dtype=np.uint64, count=high, offset=at + 8 * low)
        return cls(n, bits, lows, highs), at + 8 * (low + high)


class Trie:
    """Contexts, pointers to their successors, successors, and one quantised value per successor.

    Successors are stored relative to the last value of the context before, which makes the level monotone.
    """

    MISSING = np.uint16(0xFFFF)

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, values: np.ndarray):
        self.contexts, self.pointers, self.successors, self.values = contexts, pointers, successors, values

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, values: np.ndarray) -> Trie:
        """From entries sorted by (context, successor), each pair once; values are below MISSING."""
        names, begin = np.unique(context, return_index=True)
        sizes = np.diff(np.append(begin, len(context)))
        last = successor[begin + sizes - 1] if len(names) else successor[:0]
        base = np.concatenate([np.zeros(min(1, len(names)), dtype=np.uint64), np.cumsum(last.astype(np.uint64))[:-1]])
        level = successor.astype(np.uint64) + np.repeat(base, sizes)
        return cls(EliasFano.of(names), EliasFano.of(np.append(begin, len(context))), EliasFano.of(level), values.astype(np.uint16))

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        out = np.full(len(context), self.MISSING, dtype=np.uint16)
        everywhere = np.zeros(len(context), dtype=np.int64)
        place = self.contexts.successor(context.astype(np.uint64), everywhere, everywhere + self.contexts.n)
        known = np.flatnonzero(place >= 0)
        if not len(known):
            return out
        first = self.pointers.get(place[known]).astype(np.int64)
        end = self.pointers.get(place[known] + 1).astype(np.int64)
        base = np.zeros(len(known), dtype=np.uint64)
        inner = np.flatnonzero(first > 0)
        base[inner] = self.successors.get(first[inner] - 1)
        at = self.successors.successor(successor[known].astype(np.uint64) + base, first, end)
        out[known[at >= 0]] = self.values[at[at >= 0]]
        return out

    def to_bytes(self) -> bytes:
        parts = [*self.contexts.parts(), *self.pointers.parts(), *self.successors.parts()]
        return b"".join([*parts, struct.pack("<q", len(self.values)), self.values.tobytes()])

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """Over bytes or a mapped file, without copying the levels."""
        at, levels = 0, []
        for _ in range(3):
            level, at = EliasFano.read(buffer, at)
            levels.append(level)
        (n,) = struct.unpack_from("<q", buffer, at)
        return cls(*levels, np.frombuffer(buffer, dtype=np.uint16, count=n, offset=at + 8))

    @classmethod
    def open(cls, path: str) -> Trie:
        return cls.from_buffer(np.memmap(path, dtype=np.uint8, mode="r"))
