"""Document fingerprints by one-permutation MinHash (operator 12).

Every shingle of five words is hashed once. The leading bits of the hash choose a bin, and a bin keeps its
smallest hash. Empty bins take the value of the first bin with a value in an order of bins of their own
(optimal densification; the orders are the same for all texts). Values are hashed once more with the number
of their bin, so that one value that fills many bins does not agree by chance in all of them. Of each bin the low-order bits are kept,
packed, and compared bin by bin: equal bins less those that agree by chance give the likeness. A text is
read once and its memory is that of its shingles.

For the comparison with the next document, texts are dealt by ranges of doc_id and streamed in order
through Arrow batches, where each row meets the one after it. The last row of a partition is completed by
the first of the next one that has rows: two rows a partition are joined again, all others move once.

Defined results: a null text is empty; words are runs other than the six ASCII blanks, A-Z in lower case; a text of fewer
words than a shingle has one shingle of all its words; a text without words has the empty fingerprint,
whose likeness is 1 to itself and 0 to any other. Null ids come first, ties of doc_id go by the hash of the text. Rows that repeat
follow one another. The document after the last is the first (one alone is its own). An empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.llm.simhash import shingle_hashes
from medialake.llm.words import mixed
from medialake.plans.shared import stored

SHINGLE = 5
SEED = 12
#: Powers of two: bins of a fingerprint, and bits that are kept of each.
BINS = 512
BITS = 4
#: Up to so many bins in turn are tried as givers before all are ranked.
TRIES = 8


@functools.lru_cache(maxsize=4)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it asks the others, and each one's place in that order."""
    order = np.argsort(mixed(np.arange(bins * bins, dtype=np.uint64)).reshape(bins, bins), axis=1, kind="stable").astype(np.int32)
    return order, np.argsort(order, axis=1, kind="stable").astype(np.int32)


def dense(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """``values`` of bins, those not ``filled`` given by the first filled bin of their order."""
    order, place = _orders(len(values))
    empty, givers = np.flatnonzero(~filled), np.flatnonzero(filled)
    for k in range(TRIES):
        if not len(empty) or len(givers) * len(empty) < 4096:
            break
        asked = order[empty, k]
        met = filled[asked]
        values[empty[met]] = values[asked[met]]
        empty = empty[~met]
    if len(empty):
        values[empty] = values[givers[np.argmin(place[np.ix_(empty, givers)], axis=1)]]
    return values


def fingerprint(text: str, bins: int = BINS, bits: int = BITS) -> bytes:
    """The packed fingerprint; no bytes for a text without words."""
    hashes = shingle_hashes(text, SHINGLE, SEED)
    if not len(hashes):
        return b""
    width = bins.bit_length() - 1
    smallest = np.full(bins, np.iinfo(np.uint64).max)
    np.minimum.at(smallest, (hashes >> np.uint64(64 - width)).astype(np.int64), hashes & np.uint64((1 << (64 - width)) - 1))
    values = dense(smallest, smallest != np.iinfo(np.uint64).max)
    kept = mixed(values ^ mixed(np.arange(bins, dtype=np.uint64))) & np.uint64((1 << bits) - 1)
    return np.packbits(np.unpackbits(kept.astype(np.uint8)[:, None], axis=1)[:, 8 - bits :]).tobytes()


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two texts' shingles, from 0 to 1."""
    if not a or not b:
        return float(a == b)
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(bins, bits).any(axis=1)
    chance = 0.5**bits
    return min(1.0, max(0.0, (1 - differ.mean() - chance) / (1 - chance)))


def edited(half: str, n_chars: int, following: str) -> str:
    """The text whose last floor(n/2) code points are replaced by the first ones of the following text."""
    return half + following[: n_chars // 2]


_FOUND = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
#: Rows at the ends of a partition: its number, which end, and the text that the other side needs.
_ENDS = {"part": pa.int32(), "end": pa.string(), "text": pa.string()}
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _batch(rows: list[dict], fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in fields.items()], names=list(fields))


def _completed(own: dict, following: str, its_print: bytes) -> dict:
    """The row of a document (doc_id, n_chars, text: its first half, fingerprint) that is followed by another."""
    text = edited(own["text"], own["n_chars"], following)
    other = fingerprint(text)
    return {k: own[k] for k in ("doc_id", "n_chars", "fingerprint")} | {
        "edited_sha256": hashlib.sha256(text.encode()).hexdigest(), "edited_fingerprint": other,
        "near_edited": likeness(own["fingerprint"], other), "near_next": likeness(own["fingerprint"], its_print),
    }


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Completed rows of a partition in order, its first text and its last row."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            own = fingerprint(text)
            if held is None:
                out.append({"fingerprint": own, "part": part, "end": "first", "text": text})
            else:
                out.append(_completed(held, text, own))
            held = {"doc_id": doc_id, "n_chars": len(text), "text": text[: len(text) - len(text) // 2], "fingerprint": own}
        yield _batch(out, _FOUND | _ENDS)
    if held:
        yield _batch([held | {"part": part, "end": "last"}], _FOUND | _ENDS)


def _complete_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_completed(r, r["following"] or "", r["its_print"] or b"") for r in batch.to_pylist()], _FOUND)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited, near_next."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    met = stored(ordered.mapInArrow(_stream, _SCHEMA + ", part int, end string, text string"))
    columns = list(_FOUND)
    # Which partition follows which: as many rows as there are partitions.
    parts = met.where("end = 'first'").select("part")
    rows = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(rows), F.min("part").over(Window.partitionBy())).alias("next"))
    first = met.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("its_print"))
    last = met.where("end = 'last'").select("part", "doc_id", "n_chars", "fingerprint", "text").join(after, "part").join(first, "next")
    return met.where("end is null").select(*columns).unionByName(last.select("doc_id", "n_chars", "fingerprint", "text", "following", "its_print").mapInArrow(_complete_ends, _SCHEMA))
