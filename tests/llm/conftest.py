"""Documents with every odd case, and a helper that reads rows."""

from __future__ import annotations

import pytest

CLASHING = {"size": "1", "key": "k", "fp": "f", "row": "r", "copies": "c", "n_lines": "x", "hashes": "h", "own": "o", "doc": "d", "block": "b", "host": "h", "declared": "d", "kept_text": "t"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def rows(*documents):
    """(doc_id, text, lang, source) with n_chars and the clashing columns."""
    return [(i, t, la, s, None if t is None else len(t), *CLASHING.values()) for i, t, la, s in documents]


@pytest.fixture(scope="session")
def documents(spark):
    """Null in any column, empty, blank and very long texts, ties, repeated rows."""
    line = "this very line is long enough to count as repeated"
    odd = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (None, "a text without an id", "en", "a"), (4, "a text without a source", "en", None),
        (5, "word " * 30_000, "en", "b"), (6, "the same words here", "en", "b"), (6, "the same words here", "en", "b"), (7, "The same WORDS here", "en", "b"),
        (8, f"one\n{line}\ntwo", "en", "b"), (9, f"{line}\n  {line.upper()}\t\nthree", "en", "b"), (10, f"{line}", "de", "c"), (11, f"x\n{line}\n", "de", "c"), (12, f"{line}\ny", "de", "c"),
        (13, "mail a.b@c.example.com or call +1 (456) 555-2186, all rights reserved, cc by 4.0", "fr", "c"),
    ]
    return spark.createDataFrame(rows(*odd), SCHEMA).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
