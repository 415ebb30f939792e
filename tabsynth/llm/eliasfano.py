"""Elias-Fano coding of monotone sequences in numpy, and the n-gram trie levels made of it.

A level holds, for the contexts in it (a monotone sequence), pointers to their ranges of
successors (monotone), the successors themselves (made monotone by adding each context's base)
and a 16-bit code for each probability.  A level is one flat buffer, which can be mapped from
a file as it is; a lookup finds the context, then searches the successor in the context's
range.  All lookups are vectorised."""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64
CODE_STEP = 1e-3  # of log10
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], dtype=np.uint8)  # place of each one


def coded(probability: np.ndarray) -> np.ndarray:
    """The 16-bit code of probabilities in (0, 1]."""
    return np.clip(np.round(-np.log10(probability) / CODE_STEP), 0, 65534).astype(np.uint16)


class EliasFano:
    """Non-decreasing numbers; about 2 + log2(largest / count) bits each."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])  # ones before each word
        self.zeros = 64 * np.arange(len(high) + 1) - self.ones
        self.mask = U64((1 << low_bits) - 1)

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=U64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        high_values = (values >> U64(low_bits)).astype(np.int64)
        at = high_values + np.arange(n)
        bits = np.zeros(((int(at[-1]) + 1 if n else 0) // 64 + 1) * 64, dtype=np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        low = np.zeros(n * low_bits // 64 + 2, dtype=U64)
        if low_bits and n:
            rest = values & U64((1 << low_bits) - 1)
            place = np.arange(n, dtype=np.int64) * low_bits
            word, shift = place >> 6, (place & 63).astype(U64)
            np.bitwise_or.at(low, word, rest << shift)
            over = (shift + U64(low_bits)) > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (U64(64) - shift[over]))
        return cls(n, low_bits, low, high)

    def dump(self) -> bytes:
        return struct.pack("<QQQQ", self.count, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, buffer, at: int) -> tuple["EliasFano", int]:
        """(sequence, where it ends); the arrays are views of the buffer."""
        count, low_bits, n_low, n_high = struct.unpack_from("<QQQQ", buffer, at)
        low = np.frombuffer(buffer, U64, n_low, at + 32)
        high = np.frombuffer(buffer, U64, n_high, at + 32 + 8 * n_low)
        return cls(count, low_bits, low, high), at + 32 + 8 * (n_low + n_high)

    @staticmethod
    def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Position of the one with so many ones below it."""
        rank, place = rank.astype(np.uint8), np.zeros(len(word), dtype=np.uint8)
        for width in (32, 16, 8):
            below = np.bitwise_count(word & U64((1 << width) - 1))
            up = rank >= below
            rank -= below * up
            shift = up * np.uint8(width)
            place += shift
            word = word >> shift
        return (place + IN_BYTE[(word & U64(255)).astype(np.int64), rank]).astype(np.int64)

    def _low_at(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), dtype=U64)
        place = index * self.low_bits
        word, shift = place >> 6, (place & 63).astype(U64)
        value = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return (value | spill) & self.mask

    def get(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, dtype=np.int64)
        word = np.searchsorted(self.ones, index, "right") - 1
        place = 64 * word + self._select_in_word(self.high[word], index - self.ones[word])
        return ((place - index).astype(U64) << U64(self.low_bits)) | self._low_at(index)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a smaller high part."""
        rank = high - 1  # the zero that ends the bucket before
        word = np.searchsorted(self.zeros, rank, "right") - 1
        inside = (rank >= 0) & (word < len(self.high))
        out = np.where(rank < 0, 0, self.count)
        w, r = word[inside], rank[inside]
        out[inside] = 64 * w + self._select_in_word(~self.high[w], r - self.zeros[w]) - r
        return out

    def successor(self, value: np.ndarray) -> np.ndarray:
        """Index of the first number not below each value (count if there is none)."""
        value = np.asarray(value, dtype=U64)
        high = (value >> U64(self.low_bits)).astype(np.int64)
        first, last = self._bucket(high), self._bucket(high + 1)
        want = value & self.mask
        active = np.flatnonzero(first < last)
        while len(active):
            middle = (first[active] + last[active]) >> 1
            below = self._low_at(middle) < want[active]
            first[active] = np.where(below, middle + 1, first[active])
            last[active] = np.where(below, last[active], middle)
            active = active[first[active] < last[active]]
        return np.minimum(first, self.count)


class TrieLevel:
    """Successor probabilities by context."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, probability: np.ndarray) -> "TrieLevel":
        """From distinct (context, word) pairs in order, with probabilities in (0, 1]."""
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, dtype=np.int64)
        ends = np.append(starts[1:], len(context)).astype(np.int64)
        bases = np.concatenate([[0], np.cumsum(word[ends - 1].astype(U64) + U64(1))[:-1]]).astype(U64) if len(starts) else np.zeros(0, dtype=U64)
        monotone = word.astype(U64) + np.repeat(bases, ends - starts)
        return cls(EliasFano.build(context[starts]), EliasFano.build(np.append(starts, len(context))), EliasFano.build(monotone), coded(probability))

    def dump(self) -> bytes:
        return self.contexts.dump() + self.pointers.dump() + self.successors.dump() + struct.pack("<Q", len(self.codes)) + self.codes.tobytes()

    @classmethod
    def load(cls, buffer) -> "TrieLevel":
        at, parts = 0, []
        for _ in range(3):
            part, at = EliasFano.load(buffer, at)
            parts.append(part)
        (n,) = struct.unpack_from("<Q", buffer, at)
        return cls(*parts, np.frombuffer(buffer, np.uint16, n, at + 8))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each (context, word) in the level, -1 where it has none.  Queries in order
        of context look each context up once."""
        out = np.full(len(context), -1, dtype=np.int64)
        if not len(context) or not self.contexts.count:
            return out
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        some = context[heads].astype(U64)
        at = self.contexts.successor(some)
        known = at < self.contexts.count
        known[known] = self.contexts.get(at[known]) == some[known]
        begin, end, base = (np.zeros(len(some), dtype=np.int64) for _ in range(3))
        begin[known], end[known] = self.pointers.get(at[known]), self.pointers.get(at[known] + 1)
        after = known & (begin > 0)
        base[after] = self.successors.get(begin[after] - 1) + U64(1)
        each = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(context))))
        here = known[each]
        want = word[here].astype(U64) + base[each][here].astype(U64)
        place = self.successors.successor(want)
        hit = place < end[each][here]
        hit[hit] = self.successors.get(place[hit]) == want[hit]
        out[here] = np.where(hit, place, -1)
        return out

    def probability(self, place: np.ndarray) -> np.ndarray:
        """The dequantised probability at each place, 0 for -1."""
        if not len(self.codes):
            return np.zeros(len(place))
        return np.where(place >= 0, 10.0 ** (-CODE_STEP * self.codes[np.maximum(place, 0)].astype(float)), 0.0)
