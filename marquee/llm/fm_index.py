"""An FM-index over numbered words: sorted suffixes, wavelet-tree ranks and sampled positions, in numpy."""

from __future__ import annotations

import numpy as np

#: Every so many positions of a run, the position of its suffix is kept.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` in order; each 0 is an end of its own, smaller than all words.

    Keys of as many symbols as fit into 62 bits are sorted first; then only suffixes that are still equal are
    sorted by the rank of what follows, twice as far each time. Ends are unique, so ties cannot outlast a run.
    """
    n = len(symbols)
    ends = symbols == 0
    count = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + count - 1)
    bits = max(1, int(count + symbols.max(initial=0)).bit_length())
    reach = min(n, max(1, 62 // bits))
    key = np.zeros(n, np.int64)
    for ahead in range(reach):
        key <<= bits
        key[: n - ahead] |= rank[ahead:]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    starts = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, slots, 0))
    open_slots = slots[~(starts & np.append(starts[1:], True))]
    while len(open_slots):
        tied = order[open_slots]
        ahead = tied + reach
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        by_key = np.argsort(key, kind="stable")
        tied, key = tied[by_key], key[by_key]
        order[open_slots] = tied
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        rank[tied] = np.maximum.accumulate(np.where(starts, open_slots, 0))
        open_slots = open_slots[~(starts & np.append(starts[1:], True))]
        reach *= 2
    return order


class WaveletTree:
    """Symbols by their bits, highest first; per level the ones before each place and where the ones begin."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.shifts = range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        for shift in self.shifts:
            bit = (symbols >> shift & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(alphabet)
        self.first = self._descend(every, np.zeros(alphabet, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros):
            before = ones[at]
            at = np.where(symbols >> shift & 1, zeros + before, at - before)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._descend(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbols = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at]
            bit = ones[at + 1] - before
            symbols = symbols << 1 | bit
            at = np.where(bit, zeros + before, at - before)
        return symbols, at - self.first[symbols]


class FmIndex:
    """Index of runs of words 1 .. alphabet-1, each run followed by a 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.ranks = WaveletTree(symbols[order - 1], alphabet)  # before the first comes the last, an end
        counts = np.bincount(symbols, minlength=alphabet)
        self.smaller = np.cumsum(counts) - counts
        ends = np.flatnonzero(symbols == 0)
        lengths = np.diff(ends, prepend=-1)
        in_run = np.arange(self.size) - np.repeat(np.concatenate([[0], ends[:-1] + 1]), lengths)
        sampled = in_run[order] % SAMPLE == 0  # the start of a run is, so no walk leaves its run
        self.before = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase, word by word from its end."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for step in range(phrases.shape[1]):
            active = np.flatnonzero((lengths > step) & (low < high))
            if not len(active):
                break
            word = phrases[active, lengths[active] - 1 - step]
            low[active] = self.smaller[word] + self.ranks.rank(word, low[active])
            high[active] = self.smaller[word] + self.ranks.rank(word, high[active])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes: back to the next sampled one, and as many words on."""
        positions = np.empty(len(rows), np.int64)
        walking, at = np.arange(len(rows)), rows
        for walked in range(SAMPLE):
            known = self.before[at + 1] > self.before[at]
            positions[walking[known]] = self.positions[self.before[at[known]]] + walked
            walking, at = walking[~known], at[~known]
            if not len(walking):
                break
            word, occurrence = self.ranks.access(at)
            at = self.smaller[word] + occurrence
        return positions
