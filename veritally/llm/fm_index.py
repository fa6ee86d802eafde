"""A word-level FM-index: BWT in a wavelet matrix of packed bits, backward search over many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64 bits a word and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """A wavelet matrix: a level for each bit of the symbols, highest first; zeros go left, ones right."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for shift in range(self.depth - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def within(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of [low, high) of each symbol in the last level's order, where equal symbols lie together."""
        both = np.concatenate([low, high])
        twice = np.concatenate([symbol, symbol])
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(both)
            both = np.where((twice >> (self.depth - 1 - level)) & 1 == 1, zeros + ones, both - ones)
        return both[: len(low)], both[len(low) :]


class Index:
    """The FM-index of a sequence of words with pieces parted by a symbol of its own.

    Suffixes are sorted by their first 2 ** k >= `depth` words, which is all that patterns of `depth` words need.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, depth: int):
        """words: hashes of all pieces in turn; ends: the end of each piece."""
        self.depth = depth
        alphabet, ids = np.unique(words, return_inverse=True)
        self.sigma = len(alphabet) + 1
        n = len(words) + len(ends)
        self.place = np.arange(len(words)) + np.searchsorted(ends, np.arange(len(words)), "right")
        text = np.zeros(n, np.int32)
        text[self.place] = ids + 1
        del ids
        self.text, self.n = text, n
        # the rank of the first 2 ** k words; `key`, of the first depth - 1, is put together from them on the way
        rank, size, key, done = text, 1, np.zeros(n, np.int32), 0
        while True:
            if (depth - 1) & size:
                key = self._ranked(key, rank, done)
                done += size
            if size >= depth:
                break
            rank = self._ranked(rank, rank, size)
            size *= 2
        order = np.argsort(rank, kind="stable").astype(np.int32)
        del rank
        # suffixes that agree in their first depth - 1 words lie together: blocks of the order
        key = key[order]
        new = np.ones(n + 1, bool)
        new[1:n] = key[1:] != key[:-1]
        edges = np.flatnonzero(new).astype(np.int32)
        block = np.cumsum(new[:n], dtype=np.int32) - 1
        del key
        self.block_start, self.block_end = edges[block], edges[block + 1]
        bwt = text[order - 1]
        self.wavelet = Wavelet(bwt, self.sigma)
        counts = np.bincount(text, minlength=self.sigma)
        self.before = np.cumsum(counts) - counts
        # the last level holds equal symbols together, from here on
        symbols = np.arange(self.sigma)
        self.base = self.wavelet.within(symbols, np.zeros(self.sigma, np.int64), np.zeros(self.sigma, np.int64))[0]

    @staticmethod
    def _ranked(first: np.ndarray, second: np.ndarray, by: int) -> np.ndarray:
        """Ranks of the pairs of first[i] and second[i + by]; past the end comes least."""
        n = len(first)
        pair = first.astype(np.int64) * (int(second.max(initial=0)) + 2)
        pair[: max(0, n - by)] += second[by:].astype(np.int64) + 1
        return np.unique(pair, return_inverse=True)[1].astype(np.int32)

    def step(self, symbol, low, high):
        """From the suffixes [low, high) that begin with a pattern to those that begin with symbol + pattern."""
        a, b = self.wavelet.within(symbol, low, high)
        shift = self.before[symbol] - self.base[symbol]
        return a + shift, b + shift

    def matches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each place of the text, how often the `depth` words from there on occur; 0 where fewer are left of the piece.

        start, end: of each piece in the text. All pieces are streamed at once from their right ends; a match is kept at
        `depth` words at most, by going back to its block of depth - 1 before it is extended.
        """
        found = np.zeros(self.n, np.int64)
        order = np.argsort(start - end, kind="stable")
        start, end = start[order], end[order]
        length = end - start
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        for step in range(1, int(length.max(initial=0)) + 1):
            on = int(np.searchsorted(-length, -step, "right"))
            at = end[:on] - step
            low, high = self.step(self.text[at], low[:on], high[:on])
            if step >= self.depth:
                found[at] = high - low
                low, high = self.block_start[low], self.block_end[low]
        return found
