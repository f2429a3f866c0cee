"""Weighted ratio of two strings (0 to 100) from the published definitions over indel similarity."""

from __future__ import annotations

import numpy as np


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, windows at the ends cut short."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    own = set(a)
    # A window that ends with another character is no better than the one before it; the last ones run over the end.
    windows = {b[max(0, i) : i + n] for i in range(1 - n, len(b)) if i + n > len(b) or b[i + n - 1] in own} or {b[:1]}
    best = max(ratio(a, w) for w in windows)
    if len(a) == len(b):
        best = max(best, max(ratio(b, a[max(0, i) : i + n]) for i in range(1 - n, n)))
    return best


def _sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_ratio(a: str, b: str) -> float:
    """The better one of the ratio of sorted tokens and that of common tokens against each side."""
    best = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    both, x, y = _sets(a, b)
    if both and (not x or not y):
        return 100.0
    with_x, with_y = f"{both} {x}".strip(), f"{both} {y}".strip()
    best = max(best, ratio(with_x, with_y))
    return max(best, ratio(both, with_x), ratio(both, with_y)) if both else best


def partial_token_ratio(a: str, b: str) -> float:
    both, x, y = _sets(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(x, y))


def weighted_ratio(a: str, b: str) -> float:
    """Ratio of the whole strings, of their tokens, and of parts where lengths differ much."""
    if not a or not b:
        return 0.0
    plain = ratio(a, b)
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(plain, 0.95 * token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def partial_ratios(a: str, others: list[str]) -> np.ndarray:
    """``partial_ratio`` of ``a`` with each string; all windows of the longer ones are taken at once, bit-parallel over ``a``."""
    n = len(a)
    at = [i for i, b in enumerate(others) if 0 < n < min(len(b), 64)]
    long = set(at)
    best = np.array([0.0 if i in long else partial_ratio(a, b) for i, b in enumerate(others)])
    if not at:
        return best
    # Gaps of n - 1 between texts: no window meets two of them, and those over an end are cut short.
    gap = "\0" * (n - 1)
    points = np.frombuffer((gap + gap.join(others[i] for i in at) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(others[i]) for i in at]) + n - 1
    first = np.cumsum(sizes) - sizes
    real = np.ones(len(points), np.int64)
    for k in range(n - 1):
        real[np.append(first, len(points) - n + 1) + k] = 0
    masks = np.zeros(len(points), np.uint64)
    for c in set(a):
        masks[(points == ord(c)) & (real == 1)] = sum(1 << i for i, x in enumerate(a) if x == c)
    windows, full = len(points) - n + 1, np.uint64((1 << n) - 1)
    row = np.full(windows, full)
    for k in range(n):
        met = row & masks[k : k + windows]
        row = (row + met | row - met) & full
    before = np.concatenate([[0], np.cumsum(real)])
    own = before[n:] - before[:-n]
    best[at] = np.maximum.reduceat(200.0 * (n - np.bitwise_count(row).astype(np.int64)) / (n + own), first)
    return best


def weighted_ratios(a: str, others: list[str]) -> np.ndarray:
    """``weighted_ratio`` of ``a`` with each string, those of parts together."""
    apart = [i for i, b in enumerate(others) if a and b and max(len(a), len(b)) / min(len(a), len(b)) >= 1.5]
    parts = set(apart)
    best = np.array([0.0 if i in parts else weighted_ratio(a, b) for i, b in enumerate(others)])
    some = [others[i] for i in apart]
    tokens = set(a.split())
    shared = np.array([not tokens.isdisjoint(b.split()) for b in some], bool)
    whole = np.where(shared, 100.0, 0.0)
    new = [b for b, s in zip(some, shared) if not s]
    whole[~shared] = np.maximum(
        partial_ratios(" ".join(sorted(a.split())), [" ".join(sorted(b.split())) for b in new]), partial_ratios(" ".join(sorted(tokens)), [" ".join(sorted(set(b.split()))) for b in new])
    )
    scale = np.array([0.9 if max(len(a), len(b)) / min(len(a), len(b)) <= 8 else 0.6 for b in some])
    best[apart] = np.maximum(scale * partial_ratios(a, some), 0.95 * scale * whole)
    for i in apart:
        # The shorter one may lie within the longer one as a whole: only where that could be more is the ratio taken.
        if 200.0 * min(len(a), len(others[i])) / (len(a) + len(others[i])) > best[i]:
            best[i] = max(best[i], ratio(a, others[i]))
    return best
