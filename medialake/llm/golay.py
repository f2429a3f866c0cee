"""The perfect binary Golay code (23, 12, 7) as a table from every 23-bit word to its codeword's number."""

from __future__ import annotations

import functools
import itertools

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH = 23


@functools.lru_cache(maxsize=1)
def nearest_codeword() -> np.ndarray:
    """Number of the codeword within three bits of each 23-bit word (int16, 2^23 entries, 16 MB)."""
    numbers = np.arange(4096, dtype=np.int64)
    words = np.zeros(4096, np.int64)
    for k in range(12):
        words ^= np.where((numbers >> k) & 1, GENERATOR << k, 0)
    table = np.empty(1 << LENGTH, np.int16)
    for weight in range(4):
        for flips in itertools.combinations(range(LENGTH), weight):
            table[words ^ sum(1 << f for f in flips)] = numbers
    return table


def nearby_codewords(words: np.ndarray, width: int) -> np.ndarray:
    """For each word the numbers of the codewords nearest to it and to its one-bit neighbours.

    Two words of ``width`` bits that differ in one or two bits have a word between them that is at
    most one bit from both, so they share a number. Shape (n, 1 + width); numbers repeat within a row.
    """
    flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
    return nearest_codeword()[words.astype(np.int64)[:, None] ^ flips]


def distinct_in_rows(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each distinct number, the number)."""
    ordered = np.sort(numbers, axis=1)
    first = np.ones(ordered.shape, bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    return np.nonzero(first)[0], ordered[first]
