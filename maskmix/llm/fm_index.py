"""FM-index over a sequence of word numbers: backward search by wavelet-matrix ranks, and locate.

All queries run on numpy arrays of patterns at once.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.total = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access over symbols, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for level in range(bits - 1, -1, -1):
            ones = ((symbols >> level) & 1).astype(bool)
            zeros = int(len(ones) - np.count_nonzero(ones))
            self.levels.append((level, BitRank(ones), zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before place ``i``."""
        start = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            s, e = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + s, start - s), np.where(one, zeros + e, i - e)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place ``i`` and how often it occurs before."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            symbol |= one.astype(np.int64) << level
            s, e = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + s, start - s), np.where(one, zeros + e, i - e)
        return symbol, i - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order.  The last symbol must be smaller than all and occur once.

    Suffixes are sorted by as many leading symbols as fit 62 bits; then only those still tied are
    sorted on, each time by twice as many symbols."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    depth = max(1, min(62 // bits, n))
    key = np.zeros(n, dtype=np.int64)
    for j in range(depth):
        key <<= bits
        key[: n - j] |= symbols[j:]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is the place of its first
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied = np.flatnonzero(np.repeat(size, size) > 1)
    while len(tied):
        at = order[tied]
        follow = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)], -1)
        group = head[tied]
        by = np.lexsort((follow, group))
        at, follow = at[by], follow[by]
        order[tied] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        head[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rank[at] = head[tied]
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        depth *= 2
    return order


class FMIndex:
    """Index of texts joined into one sequence.

    ``texts`` are arrays of symbols from 1 on; each is closed by a separator of its own in the
    suffix order, and separators share the symbol 0 in the index, because no pattern has one.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, sampling: int = 16):
        """``symbols`` holds 0 at the end of every text; ``starts`` are the places where texts begin."""
        n = len(symbols)
        separators = np.flatnonzero(symbols == 0)
        order = symbols.astype(np.int64) + len(separators)
        order[separators] = np.arange(len(separators))[::-1]  # the last is the smallest
        suffixes = suffix_array(order)
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.bwt = WaveletMatrix(symbols[suffixes - 1].astype(np.int64), self.bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=(1 << self.bits)))])
        sampled = np.zeros(n, dtype=bool)  # every text start is sampled: locate never passes a separator
        sampled[::sampling] = True
        sampled[starts] = True
        in_order = sampled[suffixes]
        self.marked = BitRank(in_order)
        self.places = suffixes[in_order]
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern.  A pattern is right-aligned in its
        row of ``patterns``; a symbol outside the index (negative) never matches."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        most = patterns.shape[1]
        for k in range(most - 1, -1, -1):
            live = np.flatnonzero((most - k <= lengths) & (low < high))
            if not len(live):
                continue
            symbol = patterns[live, k].astype(np.int64)
            inside = (symbol > 0) & (symbol < len(self.first) - 1)
            high[live[~inside]] = low[live[~inside]]
            live, symbol = live[inside], symbol[inside]
            low[live], high[live] = (self.first[symbol] + self.bwt.rank(symbol, x[live]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffix rows: steps back through the text until a sampled place."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marked.get(rows[open_]).astype(bool)
            done = open_[hit]
            out[done] = self.places[self.marked.rank(rows[done])] + steps
            open_ = open_[~hit]
            symbol, before = self.bwt.access(rows[open_])
            rows[open_] = self.first[symbol] + before
            steps += 1
        return out
