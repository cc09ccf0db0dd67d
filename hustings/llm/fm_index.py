"""A compressed FM-index over word numbers, and batched matching statistics by backward search.

The text is an int array, 0 its separators. The Burrows-Wheeler transform lies in a wavelet tree (as a matrix: a bit vector
for each bit of the word numbers, in 64-bit blocks with running counts). All queries step backwards together. A query keeps
the interval of the longest match that starts at its place, up to `depth` words: before a step the interval is widened to that
of the first depth - 1 words; where a word doesn't fit, to the longest prefix with which it does. Reported are the places whose
match reaches depth, by the number of the class of suffixes that share those words.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in the order of their first words, at least depth of them, by doubling; and the ranks of each step."""
    n = len(text)
    rank = text.astype(np.int64)
    ranks, k = [rank], 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        by = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, by[1:] != by[:-1]))
        ranks.append(rank)
        k *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order (0 for the first), exact below twice the last step."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n, np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        fine = (a < n) & (b < n)
        same = fine & (ranks[j][np.minimum(a, n - 1)] == ranks[j][np.minimum(b, n - 1)])
        step = np.where(same, 1 << j, 0)
        a += step
        b += step
        out[1:] += step
    return out


class WaveletTree:
    def __init__(self, values: np.ndarray, most: int):
        self.bits = max(1, int(most).bit_length())
        self.blocks, self.counts, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            block = np.zeros(len(values) // 64 + 1, np.uint64)
            block.view(np.uint8)[: len(packed)] = packed
            self.blocks.append(block)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(block))]).astype(np.int32))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often value occurs before place, for each pair."""
        start = np.zeros_like(place)
        both = np.concatenate([start, place])
        n = len(place)
        for level, block, count, zeros in zip(range(self.bits - 1, -1, -1), self.blocks, self.counts, self.zeros, strict=True):
            at = both >> 6
            ones = count[at] + np.bitwise_count(block[at] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)))
            one = (value >> level & 1).astype(bool)
            one = np.concatenate([one, one])
            both = np.where(one, zeros + ones, both - ones)
        return both[n:] - both[:n]


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.n = depth, len(text)
        self.order, ranks = suffix_order(text, depth)
        self.shared = common_prefixes(self.order, ranks)
        most = int(text.max()) if len(text) else 0
        self.tree = WaveletTree(text[self.order - 1], most)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        self.most = most
        self.group = np.cumsum(np.append(0, self.shared[1:] < depth))  # class of suffixes that share depth words
        edge = np.flatnonzero(np.append(True, self.shared[1:] < depth - 1))
        own = np.cumsum(np.append(0, self.shared[1:] < depth - 1))
        self.low, self.high = edge[own], np.append(edge[1:], self.n)[own]  # widest interval around a suffix that shares depth - 1
        self._least: list[np.ndarray] | None = None

    def least_by_group(self, value: np.ndarray) -> np.ndarray:
        """The least value, given for each place of the text, in each class."""
        return np.minimum.reduceat(value[self.order], np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1])))

    def _step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = (word > 0) & (word <= self.most)
        word = np.where(known, word, 0)
        two = self.tree.rank(np.concatenate([word, word]), np.concatenate([low, high]))
        a, b = self.first[word] + two[: len(word)], self.first[word] + two[len(word) :]
        return np.where(known, a, 0), np.where(known, b, 0)

    def _widened(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first depth words of any suffix in each interval: to the next places that share fewer."""
        if self._least is None:  # least shared[i : i + 2**j]
            self._least = [np.append(self.shared, -1)]  # fewer than any at the end
            self._least[0][0] = -1
            while 2 << (len(self._least) - 1) <= self.n + 1:
                w = 1 << (len(self._least) - 1)
                self._least.append(np.minimum(self._least[-1][:-w], self._least[-1][w:]))
        low, high = low.copy(), high.copy()
        for j in range(len(self._least) - 1, -1, -1):
            w = 1 << j
            row = self._least[j]
            at = low - w + 1  # shared[at : low + 1] all >= depth: the place before them is in the interval
            can = (at >= 0) & (row[np.clip(at, 0, len(row) - 1)] >= depth)
            low = np.where(can, low - w, low)
            can = (high + w <= self.n + 1) & (row[np.clip(high, 0, len(row) - 1)] >= depth)
            high = np.where(can, high + w, high)
        return low, high

    def matches(self, queries: np.ndarray, ends: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match (at most depth) and class (where it is depth, else -1) of the suffix from each place.

        queries: word numbers of all queries; ends: for each query, the place after its last word; steps: words of each at most,
        0 stops a query. Places that no query covers have length 0.
        """
        length, found = np.zeros(len(queries), np.int64), np.full(len(queries), -1, np.int64)
        low, high, deep = np.zeros(len(ends), np.int64), np.full(len(ends), self.n), np.zeros(len(ends), np.int64)
        place, live = ends - 1, np.arange(len(ends))
        for _ in range(steps):
            live = live[(place[live] >= 0)]
            live = live[queries[place[live]] > 0]
            if not len(live):
                break
            word, lo, hi, d = queries[place[live]], low[live], high[live], deep[live]
            full = d == self.depth
            lo, hi, d = np.where(full, self.low[np.minimum(lo, self.n - 1)], lo), np.where(full, self.high[np.minimum(lo, self.n - 1)], hi), np.where(full, self.depth - 1, d)
            a, b = self._step(word, lo, hi)
            d = d + 1
            bad = np.flatnonzero(a >= b)
            if len(bad):  # the longest prefix with which the word fits: by halving
                w, least, most = word[bad], np.full(len(bad), -1), d[bad] - 1
                got_a, got_b = np.zeros(len(bad), np.int64), np.full(len(bad), self.n)
                while (least + 1 < most).any():
                    half = np.where(least + 1 < most, (least + most) // 2, least)
                    root = half <= 0
                    x, y = self._widened(lo[bad], np.maximum(hi[bad], lo[bad] + 1), np.maximum(half, 1))
                    x, y = self._step(w, np.where(root, 0, x), np.where(root, self.n, y))
                    fits, open_ = x < y, least + 1 < most
                    got_a, got_b = np.where(open_ & fits, x, got_a), np.where(open_ & fits, y, got_b)
                    least, most = np.where(open_ & fits, half, least), np.where(open_ & ~fits, half, most)
                a[bad], b[bad], d[bad] = got_a, got_b, least + 1
            low[live], high[live], deep[live] = a, b, d
            length[place[live]] = d
            hit = d == self.depth
            found[place[live][hit]] = self.group[a[hit]]
            place[live] -= 1
        return length, found
