"""Byte-pair merging for many words at once.

All words lie in one flat symbol array. In each round every word merges its pairs of least rank, leftmost first and all
at once; merged symbols are squeezed out, finished words leave. Where one of these merges makes a new pair that would
come before the others, the word does its leftmost merge only. That is the order in which the libraries merge, so that
the result is theirs. Words of any length take the same rounds.
"""

from __future__ import annotations

import heapq

import numpy as np

from .common import ragged

NONE = np.int64(1) << 30
#: Left symbols are shifted by so many bits in pair keys.
SHIFT = 21


class Pairs:
    """(left, right) -> (rank, merged symbol), an open-addressing hash table of arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.dict = pairs
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.mask, self.shift = size - 1, np.uint64(64 - (size.bit_length() - 1))
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int64)
        self.merged = np.zeros(size, np.int64)
        keys = np.array([a << SHIFT | b for a, b in pairs], np.int64)
        for k, slot, (rank, merged) in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values()):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.rank[slot], self.merged[slot] = k, rank, merged

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left << SHIFT | right
        slot = self._slot(keys)
        found = self.keys[slot]
        wrong = np.flatnonzero((found != keys) & (found != -1))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            found = self.keys[slot[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found != -1)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.rank[slot], NONE), self.merged[slot]


def merge_one(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same for one word, by a heap of (rank, place); merge() is tested against it."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (found := pairs.get((symbols[i], symbols[after[i]]))):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[after[i]], found[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = merged, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s >= 0]


def _leftmost(sym: np.ndarray, rank: np.ndarray, merged: np.ndarray, n: np.ndarray, least: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that one round merges, and their words' numbers: every word's pairs of least rank, without those that overlap one before."""
    at = np.flatnonzero((rank == np.repeat(least, n)) & (rank < NONE))
    k = np.arange(len(at))
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    at = at[(k - np.maximum.accumulate(np.where(first, k, 0))) % 2 == 0]
    ends = np.cumsum(n)
    of = np.searchsorted(ends, at, "right")
    many = np.bincount(of, minlength=len(n))[of] > 1
    if many.any():
        # new pairs with the symbol to the left, as merged by then, and with that to the right, before its own merge
        x, w = at[many], of[many]
        new, left = merged[x], sym[np.maximum(x - 1, 0)]
        beside = np.flatnonzero(x[1:] == x[:-1] + 2) + 1
        left[beside] = new[beside - 1]
        right = sym[np.minimum(x + 2, len(sym) - 1)]
        early = (pairs.find(left, new)[0] <= least[w]) & (x > (ends - n)[w])
        early |= (pairs.find(new, right)[0] <= least[w]) & (x + 2 < ends[w])
        if early.any():
            odd = np.zeros(len(n), bool)
            odd[w[early]] = True
            lead = np.ones(len(at), bool)
            lead[1:] = of[1:] != of[:-1]
            at, of = at[lead | ~odd[of]], of[lead | ~odd[of]]
    return at, of


def merge(symbols: np.ndarray, lens: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols and lengths of words, which are given by flat symbols and lengths of at least one."""
    out_lens = lens.astype(np.int64).copy()
    done_words: list[np.ndarray] = []
    done_symbols: list[np.ndarray] = []
    words = np.flatnonzero(lens > 0)
    sym, n = symbols.astype(np.int64), lens[words].astype(np.int64)
    if len(words):
        ends = np.cumsum(n)
        rank, merged = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], merged[:-1] = pairs.find(sym[:-1], sym[1:])
        rank[ends - 1] = NONE
    while len(words):
        ends = np.cumsum(n)
        starts = ends - n
        least = np.minimum.reduceat(rank, starts)
        live = least < NONE
        if int((~live).sum()) * 4 >= len(words):  # finished words leave
            gone = ~live
            done_words.append(words[gone])
            done_symbols.append(ragged(sym, starts[gone], n[gone]))
            out_lens[words[gone]] = n[gone]
            keep = np.repeat(live, n)
            sym, rank, merged, words, n, least = sym[keep], rank[keep], merged[keep], words[live], n[live], least[live]
            if not len(words):
                break
        at, of = _leftmost(sym, rank, merged, n, least, pairs)
        sym[at] = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, rank, merged = sym[keep], rank[keep], merged[keep]
        n = n - np.bincount(of, minlength=len(n))
        at = at - np.arange(len(at))
        ends = np.cumsum(n)
        last, first = ends[of] - 1, (ends - n)[of]
        rank[at] = NONE
        anew = np.concatenate([at[at < last], at[at > first] - 1])
        rank[anew], merged[anew] = pairs.find(sym[anew], sym[anew + 1])
    order = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
    sizes = out_lens[order]
    begin = np.zeros(len(lens), np.int64)
    begin[order] = np.cumsum(sizes) - sizes
    return ragged(flat, begin, out_lens), out_lens


class Words(dict):
    """word -> number, in order of first sight; `fresh` are the words that still have no ids. Its size is bounded: see full()."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most, self.fresh = most, []
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.lens = np.zeros(1 << 14, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.known = 0

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def full(self) -> bool:
        return len(self) > self.most

    def learn(self, flat: np.ndarray, lens: np.ndarray) -> None:
        """Take the ids of the fresh words."""
        n, total = len(lens), int(lens.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * total, np.int32)])
        if self.known + n > len(self.lens):
            more = np.zeros(self.known + 2 * n, np.int32)
            self.lens, self.starts = np.concatenate([self.lens[: self.known], more]), np.concatenate([self.starts[: self.known], more.astype(np.int64)])
        self.flat[self.used : self.used + total] = flat
        self.lens[self.known : self.known + n] = lens
        self.starts[self.known : self.known + n] = self.used + np.cumsum(lens) - lens
        self.known, self.used, self.fresh = self.known + n, self.used + total, []

    def ids(self, at: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.starts[at], self.lens[at])
