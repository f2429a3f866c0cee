"""Token ids of whole texts with a public tokenizer file, chunk by chunk inside Arrow tasks."""

from __future__ import annotations

import contextlib
import functools
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text handled at a time inside a task.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch of texts on its way to a worker.
BATCH_BYTES = 8 << 20
#: Words whose ids a worker remembers (about 200 bytes each) before it starts afresh.
REMEMBERED = 150_000
#: Signs that together are a pre-token of their own after a word.
CLOSING = string.punctuation


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTokenizer:
    """Ids of texts by way of their distinct white-space-free chunks, whose words are remembered.

    The pre-tokenizer of the word-level vocabularies drops white space and never joins across it, and
    NFC and lower-casing never reach across it either, so the ids of a text are the ids of its chunks
    in a row. A chunk of letters and closing punctuation is two pre-tokens, so its ids are those of
    the word and those of the punctuation. A text that holds the string of an added token is encoded whole
    by the tokenizer itself, which splits it there before anything else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.letters = _byte_letters()

    def _slow(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token of lower-case letters, by the model alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(CLOSING)
        low = word.lower()
        found = self.words.get(low)
        if found is not None and (low.isascii() or _plain(word)):
            ids = found
        elif low.isalpha() and (low.isascii() and word.isascii() or _plain(word)):
            if len(self.words) > REMEMBERED:
                self.words.clear()
            ids = self.words[low] = self._word(low)
        else:
            return self._slow(chunk)
        tail = chunk[len(word) :]
        if tail not in self.tails:
            if len(tail) > 8:
                return ids + self._slow(tail)
            self.tails[tail] = self._slow(tail)
        return ids + self.tails[tail]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text as counts, all ids in a row). A null text counts as empty."""
        odd = pc.match_substring_regex(pc.fill_null(texts, ""), self.added, ignore_case=True) if self.added else None
        if odd is None or not pc.any(odd).as_py():
            return self._by_chunks(texts)
        counts, flat = self._by_chunks(pc.if_else(odd, "", texts))
        parts, ends = [], np.cumsum(counts)
        for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            ids = np.array(self.tokenizer.encode(texts[int(row)].as_py(), add_special_tokens=False).ids, np.uint32)
            parts.append((ends[row], ids))
            counts[row] = len(ids)
        at = np.concatenate([np.full(len(ids), end) for end, ids in parts])
        return counts, np.insert(flat, at, np.concatenate([ids for _, ids in parts]))

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        offsets = parts.offsets.to_numpy()
        chunks = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        if not len(chunks):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        blobs = list(map(self._chunk, chunks.dictionary.to_pylist()))
        known = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        rows = chunks.indices.to_numpy()
        lens, starts = known[rows], (np.cumsum(known) - known)[rows]
        ends = np.cumsum(lens)
        flat = np.frombuffer(b"".join(blobs), np.uint32)[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])]
        return np.diff(np.concatenate([[0], ends])[offsets - offsets[0]]), flat


def _plain(word: str) -> bool:
    """Lower-casing and NFC leave each letter of the word to itself: two-byte Latin letters but for dotted I."""
    return max(word) < "\u0250" and "\u0130" not in word


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, most: int = BATCH_BYTES):
    """Arrow batches of about ``most`` bytes in the jobs run inside: whole texts would else fill buffers of 64 MB on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first row, rows) of runs of whole texts of about ``most`` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield first, last - first
        first = last
