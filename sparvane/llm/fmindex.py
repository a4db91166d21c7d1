"""FM-index over an integer text: suffix array, wavelet-tree ranks, backward search, sampled locate.

All queries take arrays of patterns and step through them together.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, separator: int | None = None) -> np.ndarray:
    """Suffixes of text in order, by doubling the compared length; the end is below every symbol.

    Separators rank by their place, so no comparison goes past one: the rounds follow
    the longest stretch between separators, however often it is repeated.
    """
    n = len(text)
    first = text.astype(np.int64) * n
    if separator is not None:
        own = np.flatnonzero(text == separator)
        first[own] += np.arange(len(own))
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        if step < n:
            after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank, step = fresh, step * 2
        if n == 0 or rank[order[-1]] == n - 1:
            return order


class BitRank:
    """Bits with counts of ones ahead of any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.ahead = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        block, low = i >> 6, (i & 63).astype(np.uint64)
        part = self.words[np.minimum(block, len(self.words) - 1)] & ((np.uint64(1) << low) - np.uint64(1))
        return self.ahead[block] + np.bitwise_count(part)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """A level of bits for each bit of a symbol, highest first; each level is kept
    stably parted by the bits above, zeros before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels, self.zeros = [], []
        for shift in range(self.depth - 1, -1, -1):
            bits = (symbols >> shift) & 1
            self.levels.append(BitRank(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol among the first i, element by element."""
        start, i = np.zeros_like(i), i.copy()
        for depth, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - depth)) & 1 == 1
            a, b = bits.ones(start), bits.ones(i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start


class FMIndex:
    """Index of a text of symbols from 1; 0 stands for its end.

    Patterns hold no separators. Places after a separator are always sampled, so that
    locate never steps onto one.
    """

    def __init__(self, text: np.ndarray, sample: int = 8, separator: int = 1):
        text = np.concatenate((np.asarray(text, np.int64), [0]))
        order = suffix_array(text, separator)
        self.bwt = text[order - 1]
        top = int(text.max())
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 2))))
        self.tree = WaveletTree(self.bwt, top)
        kept = (order % sample == 0) | (self.bwt == separator)
        self.marked = BitRank(kept)
        self.sampled = order[kept]
        self.top = top
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the patterns, rows of symbols padded on the right."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > k) & (low < high))
            symbol = patterns[live, lengths[live] - 1 - k].astype(np.int64)
            known = symbol <= self.top
            high[live[~known]] = low[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.starts[symbol] + both[: len(live)], self.starts[symbol] + both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: step back until a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked.get(at)) if len(rows) else np.empty(0, np.int64)
        while len(todo):
            symbol = self.bwt[at[todo]]
            at[todo] = self.starts[symbol] + self.tree.rank(symbol, at[todo])
            steps[todo] += 1
            todo = todo[~self.marked.get(at[todo])]
        return self.sampled[self.marked.ones(at)] + steps
