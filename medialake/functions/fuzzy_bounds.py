"""Upper bounds of the weighted ratio from counts of characters and of pairs of characters.

Two strings of n and m characters with a common subsequence of L share at least L characters. With a blank
on both sides they share at least 3L - n - m + 1 pairs of neighbours: of the n + 1 pairs of the first, each of
its n - L characters outside the subsequence spoils two at most, each of the m - L of the other one.
Hence L <= min(S1, (S2 + n + m - 1) / 3) for S1 shared characters and S2 shared pairs. A window of the longer
string is no richer than the string; its pairs lie within it, which allows two more, and the best whole L over all its lengths is in a table. Sorting tokens and
dropping repeated ones only takes characters and pairs away, so one count of the plain text serves all forms.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import defaultdict

import numpy as np

from medialake.functions.fuzzy import weighted_ratios

#: Classes of characters and of pairs of characters that are counted, and the largest count that is held.
SINGLES, PAIRS = 64, 960
CLASSES = SINGLES + PAIRS
HELD = 255
#: Scores that are computed at a time, best bounds first.
STRIDE = 64
SLACK = 1e-6
_BLANK = re.compile(r"\s")


def _pair_class(first, second):
    return (first * 31 + second * 7 + (first ^ second >> 3)) % PAIRS + SINGLES


def features(texts: list[str]) -> np.ndarray:
    """Counts of each text in the classes, up to ``HELD``: an array of CLASSES x texts."""
    joined = "".join(f" {_BLANK.sub(' ', t)} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inner = np.ones(len(points), bool)
    ends = np.cumsum(lengths) - 1
    inner[ends] = inner[ends - lengths + 1] = False
    second = np.ones(len(points), bool)
    second[ends - lengths + 1] = False
    at = np.flatnonzero(second)
    pairs = _pair_class(points[at - 1], points[at])
    found = np.bincount(owner[inner] * CLASSES + points[inner] % SINGLES, minlength=len(texts) * CLASSES)
    found += np.bincount(owner[at] * CLASSES + pairs, minlength=len(texts) * CLASSES)
    return np.minimum(found.reshape(-1, CLASSES), HELD).astype(np.uint8).T.copy()


def sizes(texts: list[str]) -> np.ndarray:
    """Lengths of each text, of its tokens with single blanks, and of its distinct tokens: an array of 3 x texts."""
    found = np.zeros((3, len(texts)), np.int64)
    for i, text in enumerate(texts):
        tokens = text.split()
        found[:, i] = len(text), len(" ".join(tokens)), len(" ".join(set(tokens)))
    return found


class Query:
    """A query text with its own counts."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = set(text.split())
        counts = features([text])[:, 0]
        self.classes = np.flatnonzero(counts)
        self.counts = counts[self.classes][:, None]
        self.single = int(np.searchsorted(self.classes, SINGLES))
        # Without the pairs that the blanks on both sides make, which no window has to hold.
        self.inner = self.counts.copy()
        if text:
            first, last = (ord(c) for c in _BLANK.sub(" ", text[0] + text[-1]))
            for pair in (_pair_class(32, first), _pair_class(last, 32)):
                self.inner[np.searchsorted(self.classes, pair)] -= 1
        self.sizes = sizes([text])[:, 0]
        # What a full class may hide counts as shared.
        self.hidden = len(text) + 1 if (counts == HELD).any() else 0


def _ratio(shared: np.ndarray, pairs: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Bound of the ratio of strings of n and m characters."""
    common = np.minimum(shared, (pairs + n + m - 1) // 3)
    return np.where(n + m == 0, 100.0, 200.0 * np.minimum(common, np.minimum(n, m)) / np.maximum(n + m, 1))


@functools.lru_cache(maxsize=64)
def _windows(n: int) -> np.ndarray:
    """By shared characters and shared pairs, the bound of the ratio of n characters with a window of at most n."""
    shared, pairs = np.ogrid[: n + 1, : n + 2]
    best = np.zeros((n + 1, n + 2))
    for m in range(1, n + 1):
        best = np.maximum(best, 200.0 * np.minimum(np.minimum(shared, m), (pairs + n + m + 1) // 3) / (n + m))
    return best


def _partial(shared: np.ndarray, pairs: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Bound of the ratio of the shorter string with any window of the longer one that is no longer."""
    if n == 0:
        return np.where(m == 0, 100.0, 0.0)
    # Of a shorter text every window of the query is taken to hold all that they share.
    short = 200.0 * np.minimum(shared, m) / np.maximum(m + np.minimum(shared, m), 1)
    return np.where(m < n, short, _windows(n)[np.minimum(shared, n), np.minimum(pairs, n + 1)])


class Cell:
    """Texts of an index with their stored counts, compared with one query after the other."""

    def __init__(self, ids: np.ndarray, texts: list[str], counts: np.ndarray, lengths: np.ndarray):
        self.ids, self.texts, self.counts, self.sizes = ids, texts, counts, lengths
        self.holders: dict[str, list[int]] = defaultdict(list)
        for i, text in enumerate(texts):
            for token in set(text.split()):
                self.holders[token].append(i)

    def bounds(self, query: Query) -> tuple[np.ndarray, np.ndarray]:
        """Of each text an upper bound of its score with the query, and whether the score equals the bound."""
        if not query.text:
            return np.zeros(len(self.texts)), np.ones(len(self.texts), bool)
        met = np.minimum(self.counts[query.classes], query.counts)
        shared = met[: query.single].sum(axis=0, dtype=np.int64) + query.hidden
        pairs = met[query.single :].sum(axis=0, dtype=np.int64) + query.hidden
        inner = np.minimum(self.counts[query.classes[query.single :]], query.inner[query.single :]).sum(axis=0, dtype=np.int64) + query.hidden
        n, m = query.sizes, self.sizes
        own = np.zeros(len(self.texts), bool)
        for token in query.tokens:
            own[self.holders.get(token, [])] = True
        plain = _ratio(shared, pairs, n[0], m[0])
        whole = np.where(own, 100.0, np.maximum(_ratio(shared, pairs, n[1], m[1]), _ratio(shared, pairs, n[2], m[2])))
        part = np.where(own, 100.0, np.maximum(_partial(shared, pairs, n[1], m[1]), _partial(shared, pairs, n[2], m[2])))
        longer = np.maximum(m[0], n[0]) / np.maximum(np.minimum(m[0], n[0]), 1)
        scale = np.where(longer <= 8, 0.9, 0.6)
        text = np.maximum(plain, scale * _partial(shared, inner, n[0], m[0]))
        least = 0.95 * scale * part
        bound = np.where(longer < 1.5, np.maximum(plain, 0.95 * whole), np.maximum(text, least))
        # A shared token settles the token part; if the plain text can't be better, that is the score.
        known = (m[0] == 0) | own & (longer >= 1.5) & (text <= least)
        return np.where(m[0] == 0, 0.0, bound), known

    def best(self, query: Query, cutoff: float, k: int, held: list[tuple[float, int]]) -> int:
        """Adds to ``held``, a heap of the k best (score, -id) from ``cutoff`` on; returns the number of scores computed.

        Texts are scored by their bounds, the best first, until the next bound is below the kth score held.
        """

        def add(score: float, i: int) -> None:
            if score >= cutoff:
                entry = (score, -int(self.ids[i]))
                if len(held) < k:
                    heapq.heappush(held, entry)
                elif entry > held[0]:
                    heapq.heapreplace(held, entry)

        def least() -> float:
            return held[0][0] if len(held) == k else cutoff

        bound, known = self.bounds(query)
        sure = np.flatnonzero(known & (bound >= least()))
        for i in sure[np.lexsort((self.ids[sure], -bound[sure]))][:k]:
            add(float(bound[i]), i)
        open_ = np.flatnonzero(~known & (bound >= least() - SLACK))
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        scored = 0
        while scored < len(open_) and bound[open_[scored]] >= least() - SLACK:
            some = open_[scored : scored + STRIDE]
            for score, i in zip(weighted_ratios(query.text, [self.texts[i] for i in some]).tolist(), some):
                add(score, i)
            scored += len(some)
        return scored
