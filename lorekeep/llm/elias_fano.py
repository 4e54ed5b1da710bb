"""Elias-Fano sequences: sorted 64-bit values in a few bits each, with select and successor search on whole arrays of queries."""

from __future__ import annotations

import numpy as np

from lorekeep.llm.common import U64

#: Values packed at a time; their bits fill whole words.
_STEP = 1 << 16


def _pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` bits of each value, one after another, in 64-bit words; one word more, so that reads never end the array."""
    if not bits:
        return np.zeros(1, U64)
    parts = []
    for at in range(0, len(values), _STEP):
        v = np.ascontiguousarray(values[at : at + _STEP])
        parts.append(np.packbits(np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little"))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return np.concatenate([flat, np.zeros(-len(flat) % 8 + 8, np.uint8)]).view(U64)


#: 1 and 128 in every byte of a word, and masks of its odd bits, pairs and halves of bytes.
_ONES, _HIGHS = U64(0x0101010101010101), U64(0x8080808080808080)
_FIVES, _THREES, _FIFTEENS = U64(0x5555555555555555), U64(0x3333333333333333), U64(0x0F0F0F0F0F0F0F0F)


def _select_in_bytes() -> np.ndarray:
    """At 256 * rank + byte: the place of the byte's rank-th set bit."""
    table = np.zeros((8, 256), np.uint8)
    for byte in range(256):
        for rank, at in enumerate(k for k in range(8) if byte >> k & 1):
            table[rank, byte] = at
    return table.ravel()


_IN_BYTES = _select_in_bytes()


def select_in_words(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th (from 0) set bit of each word: running counts of its bytes side by side, then a table for the byte."""
    rank = rank.astype(U64)
    sums = words - (words >> U64(1) & _FIVES)
    sums = (sums & _THREES) + (sums >> U64(2) & _THREES)
    sums = (sums + (sums >> U64(4)) & _FIFTEENS) * _ONES
    # bytes whose running count doesn't exceed the rank
    at = np.bitwise_count((rank * _ONES | _HIGHS) - sums & _HIGHS).astype(U64) << U64(3)
    rank = rank - ((sums << U64(8)) >> at & U64(255))
    return at.astype(np.int64) + _IN_BYTES[(rank << U64(8) | words >> at & U64(255)).astype(np.int64)]


class EliasFano:
    """n sorted values below `universe`: upper parts in unary in a bit vector, lower parts packed."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        #: Zeros, and ones, before each word: the directory of select.
        self.zeros = zeros.astype(np.int64)
        self.ones = np.arange(len(zeros), dtype=np.int64) * 64 - self.zeros
        self.mask = U64((1 << low_bits) - 1)

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(U64)
        n = len(values)
        low_bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        size = n + (universe >> low_bits) + 2
        bits = np.zeros(size + -size % 64, np.uint8)
        if n:
            bits[(values >> U64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        return cls(n, low_bits, _pack_low(values, low_bits), high, zeros)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        kind = np.uint32 if self.zeros[-1] < 1 << 32 else np.int64
        return {f"{name}.meta": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros.astype(kind)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = arrays[f"{name}.meta"].tolist()
        return cls(n, low_bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Positions of the k-th (from 0) zeros or ones of the upper bits."""
        before = self.zeros if zero else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        w = self.high[word]
        return word * 64 + select_in_words(~w if zero else w, k - before[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i.astype(np.int64) * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U64)
        # in two steps, as 64 places are no shift
        return (self.low[word] >> shift | self.low[word + 1] << U64(1) << (U64(63) - shift)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        return (self._select(i, False) - i).astype(U64) << U64(self.low_bits) | self._low(i)

    def _ones_from(self, at: np.ndarray) -> np.ndarray:
        """How many ones follow one another in the upper bits from each position."""
        word, shift = at >> 6, (at & 63).astype(U64)
        last = len(self.high) - 1
        bits = self.high[np.minimum(word, last)] >> shift
        bits |= self.high[np.minimum(word + 1, last)] << U64(1) << (U64(63) - shift)
        out = np.bitwise_count((bits ^ (bits + U64(1))) >> U64(1)).astype(np.int64)
        long = np.flatnonzero(out >= 63)
        if len(long):  # the run may go on: up to the next zero
            p = at[long]
            ones = self._rank(p)
            out[long] = self._select(p - ones, True) - p
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        """Ones of the upper bits before each position."""
        word, shift = at >> 6, (at & 63).astype(U64)
        return self.ones[word] + np.bitwise_count(self.high[word] & ((U64(1) << shift) - U64(1)))

    def _stretches(self, values: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the places whose upper parts equal each value's, within [lo, hi) if given."""
        top = (values >> U64(self.low_bits)).astype(np.int64)
        begin = self._select(np.maximum(top, 1) - 1, True) + 1
        begin[top == 0] = 0
        start = begin - top
        end = start + self._ones_from(begin)
        if lo is not None:
            start = np.maximum(start, lo)
            end = np.maximum(np.minimum(end, hi), start)
        return start, end

    def successor(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The first place (within [lo, hi), if given) whose value isn't less than each query; hi or n where there is none."""
        values = values.astype(U64)
        a, b = self._stretches(values, lo, hi)
        want = values & self.mask
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            up = self._low(mid) < want[live]
            a[live[up]] = mid[up] + 1
            b[live[~up]] = mid[~up]
            live = live[a[live] < b[live]]
        return a

    def find(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """A place of each query (within [lo, hi), if given), or -1."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(U64)
        a, b = self._stretches(values, lo, hi)
        live = np.flatnonzero(a < b)
        a, b, want = a[live], b[live], values[live] & self.mask
        while len(live):
            mid = (a + b) >> 1
            low = self._low(mid)
            hit, up = low == want, low < want
            out[live[hit]] = mid[hit]
            a, b = np.where(up, mid + 1, a), np.where(up, b, mid)
            on = np.flatnonzero((a < b) & ~hit)
            live, a, b, want = live[on], a[on], b[on], want[on]
        return out
