"""Suffix sorting and an FM-index in numpy, for one shard at a time."""

from __future__ import annotations

import numpy as np


_PACK = 7


def suffix_ranks(symbols: np.ndarray, by_place: bool = True) -> np.ndarray:
    """The rank of each suffix; every 0 is a separator that differs from all others, in the order of place, or in any
    order, which is sorted faster.

    Prefix doubling over those suffixes only that still share their rank; small symbols begin with several at once.
    The last symbol must be a separator, so that no comparison passes the end.
    """
    n = len(symbols)
    gap = symbols == 0
    if not n:
        return np.zeros(0, np.int64)
    assert gap[-1]
    largest = int(symbols.max())
    step = _PACK if largest < 1 << 9 else 1
    width = 9 if step > 1 else largest.bit_length()
    value, ended = symbols.astype(np.int64), gap.copy()
    for j in range(1, step):
        value <<= width
        value[:-j] |= np.where(ended[:-j], 0, symbols[j:])
        ended[:-j] |= gap[j:]
        ended[-j:] = True
    kind = "stable" if by_place else None
    order = np.argsort(value, kind=kind)
    rank = np.empty(n, np.int64)
    open_ = _refine(rank, order, value[order], np.zeros(n, np.int64), ended[order])
    while len(open_):
        old = rank[open_]
        key = old * (n + 1) + rank[open_ + step]
        by = np.argsort(key, kind=kind)
        open_ = _refine(rank, open_[by], key[by], old[by], np.zeros(len(by), bool))
        step *= 2
    return rank


def _refine(rank: np.ndarray, at: np.ndarray, key: np.ndarray, old: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """New ranks of the suffixes `at`, sorted by (old rank, key); returns those that still share one. `ended`: whose
    compared part holds a separator, so that it is like no other."""
    if not len(at):
        return at
    place = np.arange(len(at))
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (key[1:] != key[:-1]) | ended[1:] | ended[:-1]
    older = np.empty(len(at), bool)
    older[0] = True
    older[1:] = old[1:] != old[:-1]
    head = np.maximum.accumulate(np.where(new, place, 0))
    rank[at] = old + head - np.maximum.accumulate(np.where(older, place, 0))
    alone = new & np.append(new[1:], True)
    return at[~alone]


def suffix_array(symbols: np.ndarray, by_place: bool = True) -> np.ndarray:
    rank = suffix_ranks(symbols, by_place)
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    return order


class Bits:
    """A bit vector with ranks: 64 bits a word and a running count of ones."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks of symbols, one bit vector for each bit of a symbol, zeros before ones on each level."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels, self.zeros = [], []
        for bit in reversed(range(max(1, int(largest).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones)))
            self.zeros.append(int(len(ones) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for (bit, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one = symbol >> bit & 1 == 1
            a, b = bits.ones(low), bits.ones(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before that place."""
        low, symbol = np.zeros_like(at), np.zeros_like(at)
        for (_, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at)
            a, b = bits.ones(low), bits.ones(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
            symbol = symbol * 2 + one
        return symbol, at - low


class FMIndex:
    """Finds all places of symbol sequences in a text whose segments are parted, begun and ended by 0."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = 8):
        order = suffix_array(symbols)
        before = symbols[order - 1]
        self.tree = WaveletTree(before, largest)
        counts = np.bincount(symbols, minlength=largest + 2)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        # each sample-th place is kept, and every segment's first, where a walk to the left must end
        kept = (order % sample == 0) | (before == 0)
        self.kept = Bits(kept)
        self.places = order[kept]
        self.size = len(symbols)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern: a row of symbols, of which the first `length` count."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for j in reversed(range(patterns.shape[1])):
            live = np.flatnonzero((j < lengths) & (low < high))
            c = patterns[live, j].astype(np.int64)
            low[live] = self.below[c] + self.tree.rank(c, low[live])
            high[live] = self.below[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text place of each suffix: steps to the left until a kept one is met."""
        out = np.empty(len(at), np.int64)
        todo, steps = np.arange(len(at)), 0
        while len(todo):
            done = self.kept.get(at)
            out[todo[done]] = self.places[self.kept.ones(at[done])] + steps
            todo, at = todo[~done], at[~done]
            symbol, rank = self.tree.access(at)
            at = self.below[symbol] + rank
            steps += 1
        return out
