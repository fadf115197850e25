"""A word-level FM-index: wavelet matrix over the Burrows-Wheeler transform, matching statistics by backward search.

Suffixes are sorted by their first `depth` symbols (prefix doubling), which is exact for matches up to that length.
Bits are packed, 64 to a machine word, with one count per word. Queries of many passages run in step, right to left,
so that each step is a few array operations.
"""

from __future__ import annotations

import numpy as np


class BitRanks:
    """A packed bit vector that counts its ones before a position."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([self.words, np.zeros(-len(self.words) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels, self.zeros = [], []
        seq = symbols
        self.n_bits = max(1, int(n_symbols - 1).bit_length())
        for level in reversed(range(self.n_bits)):
            bits = (seq >> level & 1).astype(np.uint8)
            self.levels.append(BitRanks(bits))
            self.zeros.append(int(len(seq) - bits.sum()))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])
        self.start = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, ranks in enumerate(self.levels):
            ones = ranks.ones(at)
            at = np.where(symbol >> (self.n_bits - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, at) - self.start[symbol]


class FMIndex:
    """Passages (arrays of symbols from 1) with an owner each; finds what other passages share with them."""

    def __init__(self, passages: list[np.ndarray], owners: np.ndarray, threshold: int):
        self.threshold = threshold
        size = sum(map(len, passages)) + len(passages)
        text, owner, at = np.zeros(size, np.int64), np.empty(size, np.int64), 0
        for p, o in zip(passages, owners.tolist(), strict=True):
            text[at : at + len(p)] = p  # a zero ends each passage
            owner[at : at + len(p) + 1] = o
            at += len(p) + 1
        self.n_symbols = int(text.max(initial=0)) + 1
        # ranks of the first `length` symbols, doubled up to the threshold; past the end counts as zeros
        shift = lambda a, by: np.concatenate([a[by:], np.zeros(min(by, size), a.dtype)])
        rank, length, self._steps = text, 1, [(1, text)]
        while length < threshold:
            by = min(length, threshold - length)
            key = rank * (int(rank.max(initial=0)) + 1) + shift(rank, by)
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])[: len(key)]
            rank = np.empty(size, np.int64)
            rank[order] = new
            length += by
            self._steps.append((length, rank))
        self.order = order if threshold > 1 else np.argsort(text, kind="stable")
        first = text[self.order]
        self.counts = np.searchsorted(first, np.arange(self.n_symbols + 1))
        self.matrix = WaveletMatrix(text[self.order - 1], self.n_symbols)
        group = rank[self.order]
        self.group_start = np.searchsorted(group, np.arange(int(group.max(initial=-1)) + 2))
        self.group = group
        self.least = np.minimum.reduceat(owner[self.order], self.group_start[:-1]) if size else owner
        self._lcp: list[np.ndarray] | None = None

    def _common(self) -> list[np.ndarray]:
        """Longest common prefixes of neighbours in the order, up to the threshold, with minima over powers of two."""
        if self._lcp is None:
            a, b = self.order[:-1].copy(), self.order[1:].copy()
            size, lcp = len(self.order), np.zeros(max(0, len(self.order) - 1), np.int64)
            for length, rank in reversed(self._steps):
                padded = np.append(rank, np.full(1, -1))
                ranks = padded[np.minimum(a, size)], padded[np.minimum(b, size)]
                same = (ranks[0] == ranks[1]) & (lcp + length <= self.threshold) & (a < size) & (b < size)
                step = np.where(same, length, 0)
                lcp, a, b = lcp + step, a + step, b + step
            one = np.concatenate([[-1], lcp, [-1]])  # at i: of i - 1 and i
            self._lcp = [one]
            while 2 ** len(self._lcp) <= len(one):
                half = 2 ** (len(self._lcp) - 1)
                self._lcp.append(np.minimum(self._lcp[-1][:-half], self._lcp[-1][half:]))
        return self._lcp

    def _shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next shorter match that more suffixes share: its length and interval."""
        minima = self._common()
        length = np.maximum(minima[0][lo], minima[0][hi])
        for k in reversed(range(len(minima))):
            span = 2**k
            at = np.maximum(lo - span + 1, 0)
            go = (lo >= span) & (minima[k][np.minimum(at, len(minima[k]) - 1)] >= length)
            lo = np.where(go, lo - span, lo)
            go = (hi + span < len(minima[0])) & (minima[k][np.minimum(hi, len(minima[k]) - 1)] >= length)
            hi = np.where(go, hi + span, hi)
        return length, lo, hi

    def statistics(self, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each passage and position: the longest match from there, up to the threshold, and the least owner of a match of full length (0 where there is none).

        Both are arrays of a row for each passage, padded; symbols not in the index are negative.
        """
        n, width = len(passages), max(map(len, passages), default=0)
        length, least = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        sizes = np.array([len(p) for p in passages])
        padded = np.full((n, width), -1, np.int64)
        for k, p in enumerate(passages):
            padded[k, : len(p)] = p
        lo, hi, m = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64), np.zeros(n, np.int64)
        for t in range(width):
            own = np.flatnonzero(sizes > t)
            c = padded[own, sizes[own] - 1 - t]
            a, b, got = lo[own], hi[own], m[own]
            todo = np.arange(len(own))
            bad = (c < 1) | (c >= self.n_symbols)
            a[bad], b[bad], got[bad] = 0, len(self.order), 0
            todo = todo[~bad]
            while len(todo):
                x, y, s = a[todo], b[todo], c[todo]
                x, y = self.counts[s] + self.matrix.rank(s, x), self.counts[s] + self.matrix.rank(s, y)
                found = x < y
                a[todo[found]], b[todo[found]] = x[found], y[found]
                got[todo[found]] += 1
                todo = todo[~found]
                if len(todo):
                    none = got[todo] == 0  # the symbol occurs nowhere
                    a[todo[none]], b[todo[none]] = 0, len(self.order)
                    todo = todo[~none]
                    got[todo], a[todo], b[todo] = self._shorten(a[todo], b[todo])
            full = np.flatnonzero(got >= self.threshold)
            g = self.group[a[full]]
            a[full], b[full], got[full] = self.group_start[g], self.group_start[g + 1], self.threshold
            place = sizes[own] - 1 - t
            length[own, place] = got
            least[own[full], place[full]] = self.least[g]
            lo[own], hi[own], m[own] = a, b, got
        return length, least
