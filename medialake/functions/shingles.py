"""64-bit fingerprints of texts from md5 of their word shingles, for many texts at a time."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Shingles that are hashed at a time, and the longest that md5 takes in one block of 64 bytes.
AT_ONCE = 8192
ONE_BLOCK = 55
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_K = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
_TURNS = [(np.uint32(t), np.uint32(32 - t)) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _heads(blocks: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the md5 of padded blocks, an array of 16 x n words, as n x 8 bytes."""
    a, b, c, d = (np.full(blocks.shape[1], x) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ b & (c ^ d), i
        elif i < 32:
            f, g = c ^ d & (b ^ c), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _K[i]
        f += blocks[g]
        left, right = _TURNS[i]
        a, d, c, b = d, c, b, b + (f << left | f >> right)
    return np.stack([a + _START[0], b + _START[1]], axis=1).astype("<u4").view(np.uint8)


def md5_heads(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the md5 of pieces of ``data`` (bytes), as n x 8 bytes."""
    out = np.empty((len(begins), 8), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(64, np.uint8)), 64)
    column = np.arange(64)
    short = np.flatnonzero(lengths <= ONE_BLOCK)
    for at in range(0, len(short), AT_ONCE):
        some = short[at : at + AT_ONCE]
        size = lengths[some]
        rows = windows[begins[some]]
        rows *= column < size[:, None]
        rows[np.arange(len(some)), size] = 0x80
        blocks = np.ascontiguousarray(rows.view("<u4").T).astype(np.uint32, copy=False)
        blocks[14] = size * 8
        out[some] = _heads(blocks)
    for i in np.flatnonzero(lengths > ONE_BLOCK):
        out[i] = np.frombuffer(hashlib.md5(data[begins[i] : begins[i] + lengths[i]].tobytes(), usedforsecurity=False).digest()[:8], np.uint8)
    return out


def text_prints(texts: list[str], shingle: int = 3) -> np.ndarray:
    """8 bytes for each text, as an array of texts x 8: a bit is set where more distinct word shingles' md5 have it than lack it.

    Words are runs of ASCII letters, digits and low lines; a text of fewer words is one shingle. Shingles of a text with the same
    first 64 bits of md5 are taken for the same.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    word = _WORD[raw]
    after = np.append(False, word[:-1]) & ~word
    # Every word with one blank behind it.
    data = np.where(word, raw, np.uint8(32))[word | after]
    stops = np.flatnonzero(data == 32)
    starts = np.append(0, stops[:-1] + 1)[: len(stops)]
    words = np.bincount(np.searchsorted(ends, np.flatnonzero(after), side="right"), minlength=len(texts))
    runs = np.maximum(1, words - shingle + 1)
    owner = np.repeat(np.arange(len(texts)), runs)
    before = np.cumsum(words) - words
    first = before[owner] + np.arange(len(owner)) - (np.cumsum(runs) - runs)[owner]
    full = words[owner] > 0
    last = np.minimum(first + shingle, before[owner] + words[owner]) - 1
    begins, lengths = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    begins[full] = starts[first[full]]
    lengths[full] = stops[last[full]] - begins[full]
    heads = md5_heads(data, begins, lengths)
    key = heads.view(np.uint64).ravel()
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
    heads, owner = heads[order[new]], owner[new]
    counts = np.bincount(owner, minlength=len(texts))
    found = np.empty((len(texts), 64), bool)
    for i, end in enumerate(np.cumsum(counts)):
        bits = np.unpackbits(heads[end - counts[i] : end], axis=1)
        found[i] = 2 * bits.sum(axis=0, dtype=np.int32) > counts[i]
    return np.packbits(found, axis=1)
