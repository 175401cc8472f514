"""A compressed full-text index of word sequences: a wavelet matrix over their Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bits packed in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class Wavelet:
    """Rank of a symbol in a sequence of integers: one bit vector per binary digit."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, Bits, int]] = []
        self.n = len(symbols)
        for level in reversed(range(max(int(size - 1).bit_length(), 1))):
            bits = (symbols >> level) & 1
            self.levels.append((level, Bits(bits), int(self.n - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the places of each symbol before ``at`` end after the last digit."""
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at


class FmIndex:
    """Index over ``sequences`` (lists of words) for patterns of up to ``2 * width`` words.

    Suffixes are ordered by their first words only, twice the width rounded up to a power
    of two: that is all a search for patterns this long can tell apart. ``class_of`` numbers
    the runs of suffixes that agree in ``width`` words.
    """

    def __init__(self, sequences: list[list[bytes]], width: int):
        known: dict[bytes, int] = {}
        self.coded = [np.array([known.setdefault(w, len(known) + 1) for w in words], np.int64) for words in sequences]
        end = np.zeros(1, np.int64)  # below all words, after each sequence
        text = np.concatenate([x for words in self.coded for x in (words, end)])
        self.owner = np.repeat(np.arange(len(sequences)), [len(words) + 1 for words in self.coded])
        self.size = len(known) + 1
        order, same = self._suffixes(text, width)
        self.order = order
        self.class_of = np.cumsum(~same) - 1
        self.class_starts = np.concatenate([np.nonzero(~same)[0], [len(text)]])
        last = text[order - 1]
        self.wavelet = Wavelet(last, self.size)
        counts = np.bincount(text, minlength=self.size)
        self.first = np.cumsum(counts) - counts
        self.origin = self.wavelet.follow(np.arange(self.size), np.zeros(self.size, np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes by prefix doubling, and whether each agrees with the one before it in ``width`` words."""
        n = len(text)

        def later(rank: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate([rank[by:], np.full(min(by, n), -1)])[:n]

        rank, covered, wide = text, 1, None
        while covered < 2 * width:
            if covered <= width < 2 * covered:
                wide = (rank, later(rank, width - covered))
            pair = rank * np.int64(n + 1) + later(rank, covered) + 1
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            covered *= 2
        one, two = wide[0][order], wide[1][order]
        return order, np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffix intervals after one more symbol in front."""
        base = self.first[symbol] - self.origin[symbol]
        return base + self.wavelet.follow(symbol, low), base + self.wavelet.follow(symbol, high)

    def windows(self, width: int):
        """Matching statistics of the indexed sequences, cut off at ``width``: yields (sequence numbers, starts, classes).

        All sequences are streamed backwards in step. Once ``width`` words match, the interval
        is widened to the class of its suffixes, which drops its last word, before the next
        word is put in front. A sequence is in the index itself, so no step comes to nothing.
        """
        sizes = np.array([len(q) for q in self.coded])
        by_size = np.argsort(-sizes, kind="stable")
        sizes = sizes[by_size]
        flat = np.concatenate([self.coded[i] for i in by_size])
        last = np.cumsum(sizes) - 1
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.wavelet.n, np.int64)
        for step in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -step, side="left"))  # sequences longer than the step
            low, high = self.extend(flat[last[:n] - step], low[:n], high[:n])
            if step >= width - 1:
                classes = self.class_of[low]
                yield by_size[:n], sizes[:n] - 1 - step, classes
                low, high = self.class_starts[classes], self.class_starts[classes + 1]
