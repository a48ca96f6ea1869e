"""An FM-index over a collection of integer sequences, built and searched with whole arrays.

Sequences are laid end to end, each followed by a terminator. Terminators rank by position, so a suffix is compared up
to its sequence's end only. Every suffix that starts a sequence is sampled, so no walk to a sample crosses a
terminator, whose order among equals the transform doesn't keep.
"""

import numpy as np

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; symbol 0 is a terminator, smaller than all else, ranked by position."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    spread = n + int(symbols.max(initial=0)) + 2
    step = 1
    while True:
        key = rank * spread
        key[: max(0, n - step)] += rank[step:] + 1
        key[ends] = rank[ends] * spread
        order = np.argsort(key)
        by_order = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = by_order[1:] != by_order[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        step *= 2


class Wavelet:
    """A wavelet matrix: per bit of the symbols, most significant first, a bit vector with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, bool))), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64)))))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before each position."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros(len(at), np.int64), at
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            one = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(k, at)
            symbol = symbol << 1 | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return symbol


class FMIndex:
    """symbols: positive integers, each sequence ended by a 0."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        order = suffix_array(symbols)
        begins = np.ones(self.n, bool)
        begins[1:] = symbols[:-1] == 0
        lead = np.maximum.accumulate(np.where(begins, np.arange(self.n), 0))
        sampled = ((np.arange(self.n) - lead) % SAMPLE == 0)[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols))))
        self.transform = Wavelet(symbols[order - 1], max(1, int(symbols.max(initial=1)).bit_length()))
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def ranges(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern; patterns are filled up on the right."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((k < length) & (low < high))
            symbol = patterns[live, k].astype(np.int64)
            known = (symbol > 0) & (symbol + 1 < len(self.first))
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            base = self.first[symbol]
            if k == patterns.shape[1] - 1 and (k + 1 == length).all():  # the whole index: all suffixes that start with the symbol
                low[live], high[live] = base, self.first[symbol + 1]
                continue
            low[live], high[live] = base + self.transform.rank(symbol, low[live]), base + self.transform.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps to the symbol before, until a sampled row."""
        at, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.samples[self.sample_at[at[done]]] + steps
            left, at = left[~done], at[~done]
            if len(left):
                symbol = self.transform.access(at)
                at = self.first[symbol] + self.transform.rank(symbol, at)
            steps += 1
        return out
