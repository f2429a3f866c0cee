"""Words of whole texts, cut out with byte tables, and a mixing of numbers, for the operators that count and hash them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

UPPER = range(0x41, 0x5B)
#: Bytes that are taken apart at a time.
PIECE = 1 << 20


def byte_table(stays: Callable[[int], bool]) -> bytes:
    """A table for ``bytes.translate``: A-Z in lower case, other bytes that stay, a blank for the rest."""
    return bytes(b + 32 if b in UPPER and stays(b) else b if stays(b) else 32 for b in range(256))


def word_lists(data: bytes, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, in lists of about ``piece`` bytes; no word is cut."""
    data, at = data.translate(table), 0
    while at < len(data):
        end = at + piece
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut if cut > at else data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
