"""Word and shingle hashes of whole texts, vectorised inside a task."""

from __future__ import annotations

import numpy as np

# Bytes that separate words, and a fixed random-looking value per byte.
_SPACE = np.zeros(256, bool)
SPACES = " \t\n\x0b\x0c\r"
_SPACE[[ord(c) for c in SPACES]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A"):ord("Z") + 1] += 32
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * M1)
_POWERS = np.cumprod(np.full(1 << 12, mixed(np.array([7], np.uint64))[0] | np.uint64(1), np.uint64))


def text_words(text: str | bytes, small: bool = True) -> np.ndarray:
    """64-bit hashes of the words (split at white space; A-Z in lower case unless ``small`` is unset), in order."""
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    data = _SMALL[data] if small else data
    inside = ~_SPACE[data]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    terms = _BYTES[data] * _POWERS[place & 0xFFF]
    if sizes.max() > len(_POWERS):  # very long words: another odd factor for each further block
        terms *= mixed((place >> 12).astype(np.uint64)) | np.uint64(1)
    terms[~inside] = 0
    return mixed(np.add.reduceat(terms, starts) + sizes.astype(np.uint64) * M1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` words in a row, ascending; fewer words make one shingle, none an empty set."""
    return np.unique(shingles(text_words(text), width)) if text else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words in a row, in their order."""
    if not len(words):
        return words
    take = min(width, len(words))
    n = len(words) - take + 1
    total = np.full(n, take, np.uint64)
    for i in range(take):
        total = mixed(total * M1 + words[i:i + n])
    return total
