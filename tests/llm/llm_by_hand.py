"""Brute-force versions that several tests use."""

from __future__ import annotations

import collections
import re


def lines_by_hand(docs, min_chars=40, min_docs=5):
    blanks = "\x20\t\n\x0b\x0c\r"
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    key = lambda s: lower(s.strip(blanks))
    holders = collections.defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    result = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)]))]
        result.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return collections.Counter(result)
