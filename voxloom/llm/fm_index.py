"""A compressed FM-index over sequences of integers: backward search on a wavelet matrix, for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols within a sequence, from one packed bit vector for each bit of a symbol."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (x >> level) & 1
            packed = np.zeros(len(x) // 64 + 1, np.uint64)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64)
            self.levels.append((level, packed, before, int(len(x) - bit.sum())))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` of the sequence comes to lie among the occurrences of `symbol`, in the order of the last level."""
        for level, packed, before, zeros in self.levels:
            block, one = at >> 6, ((symbol >> level) & 1).astype(bool)
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(packed[block] & mask)
            at = np.where(one, zeros + ones, at - ones)
        return at


class FMIndex:
    """Over `sequences` of symbols from 1 to `symbols`, each with a weight; patterns may be up to `depth` long.

    With `sample`, every so many-th place of the text, and each sequence's first, is kept for locate(); depth must then be the text's whole length, as
    a walk from suffix to suffix needs their full order."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, symbols: int, depth: int, sample: int = 0):
        length = np.array([len(x) + 1 for x in sequences])
        text = np.zeros(length.sum(), np.int64)  # each sequence is followed by a 0
        ends = np.cumsum(length)
        text[np.arange(len(text)) != np.repeat(ends - 1, length)] = np.concatenate(sequences)
        order = self.sorted_suffixes(text, symbols, depth)
        self.total = np.concatenate([[0], np.cumsum(np.repeat(weights, length)[order])])
        bits = int(symbols).bit_length()
        self.tree = WaveletMatrix(text[order - 1], bits)  # the symbol before each suffix
        every = np.arange(symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])[: symbols + 1] - self.tree.place(every, np.zeros(symbols + 1, np.int64))
        self.size = len(text)
        if sample:
            self.before = text[order - 1]
            self.sampled = (order % sample == 0) | (self.before == 0)  # no walk leaves its sequence
            self.places = order[self.sampled]
            self.nth = np.cumsum(self.sampled) - 1

    @staticmethod
    def sorted_suffixes(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
        """Suffixes in the order of their first `depth` symbols at least, by doubling."""
        bits = int(symbols).bit_length()
        k = max(1, 62 // bits)
        key, n = np.zeros(len(text), np.int64), len(text)
        for i in range(k):
            key <<= bits
            key[: max(0, n - i)] |= text[i:]
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) + 1
            if k >= depth or new[1:].all():
                return order
            key = rank * (n + 2)
            key[: max(0, n - k)] += rank[k:]
            k *= 2

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with a symbol and go on as those from low to high."""
        at = self.tree.place(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.first[symbol], 2)
        return at[: len(symbol)], at[len(symbol) :]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From patterns of one length, one in each row: (pattern, low, high) of those that occur, as ranges of suffixes."""
        lane = np.arange(len(patterns))
        low, high = np.zeros(len(lane), np.int64), np.full(len(lane), self.size)
        for i in range(patterns.shape[1] - 1, -1, -1):
            low, high = self.step(patterns[lane, i], low, high)
            lane, low, high = (x[low < high] for x in (lane, low, high))
        return lane, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes in the text, by steps to the left until a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            at = rows[todo]
            rows[todo] = self.tree.place(self.before[at], at) + self.first[self.before[at]]
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.places[self.nth[rows]] + steps

    def repeated(self, sequences: list[np.ndarray], window: int, least: int = 2) -> list[tuple[int, int, int]]:
        """(sequence, start, n): runs of n windows whose weighted occurrences reach `least`.

        All sequences are searched in step, from an end leftwards. Where the match from end e stops at i, it either holds
        windows, and those that start at i or before must end by i + window - 1; or no window that ends at e is frequent."""
        length = np.array([len(x) for x in sequences])
        starts = np.cumsum(length) - length
        flat = np.concatenate(sequences)
        lane = np.flatnonzero(length >= window)
        end = length[lane] - 1
        at, low, high = end + 1, np.zeros(len(lane), np.int64), np.full(len(lane), self.size)
        found = []
        while len(lane):
            # one step to the left
            symbol = flat[starts[lane] + at - 1]
            to_low, to_high = self.step(symbol, low, high)
            good = self.total[to_high] - self.total[to_low] >= least
            at, low, high = np.where(good, at - 1, at), np.where(good, to_low, low), np.where(good, to_high, high)
            stop = ~good | (at == 0)
            if stop.any():
                s = np.flatnonzero(stop)
                n = end[s] - at[s] + 1 - window + 1  # windows within the match
                hit = n > 0
                found += zip(lane[s][hit].tolist(), at[s][hit].tolist(), n[hit].tolist(), strict=True)
                end[s] = np.where(hit, at[s] - 1 + window - 1, end[s] - 1)
                done = at[s] == 0
                at[s], low[s], high[s] = end[s] + 1, 0, self.size
                keep = np.ones(len(lane), bool)
                keep[s[(end[s] < window - 1) | done]] = False
                lane, end, at, low, high = lane[keep], end[keep], at[keep], low[keep], high[keep]
        return found
