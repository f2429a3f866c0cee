"""Spelling variants by PartEnum signatures (operator 11).

Words are counted within Arrow batches before anything is shuffled. A word's letters, each with its
number among equal letters, are the ones of a binary vector; two words that differ by one inserted,
deleted or replaced letter have vectors at a Hamming distance of at most two. The dimensions are dealt
into ``PARTS`` parts. Two differences touch two parts at most, so the vectors agree in all the others:
the projections on every choice of ``PARTS - 2`` parts are the word's signatures, and no pair is missed.
Signatures are joined by equality and each pair that meets is verified by its edit distance inside the
join. A signature that more than ``bucket`` words have is not joined: its words meet under themselves and
themselves less one letter, which two near words always share and only some hundreds of words can share,
and are verified in the same way. A word's form is its most frequent near word if that is ``RATIO`` times as frequent; forms
are followed by pointer jumping, whose rounds grow with the logarithm of the longest chain, and a chain
is short because frequency grows by ``RATIO`` with each step.

Defined results: null and empty texts have no words; rows that repeat are counted each; a null doc_id is
the empty string in the checksum; ties go to the word that comes first in code-point order; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.words import byte_table, mixed, word_lists
from medialake.plans.shared import stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: One run in so many loses a letter.
SPOILT = 199
#: A form is at least so many times as frequent as its word.
RATIO = 5
PARTS = 8
#: Words of a signature up to which all its pairs are verified in the join.
BUCKET = 32
#: Distinct words that a task counts before it hands them on.
HELD = 400_000

#: Of Latin-1 text: letters of ASCII and U+00C0 to U+00FF, only A-Z in lower case.
LETTERS = byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0)


def document_words(doc_id: int | None, text: str) -> Counter:
    """Runs of letters (Latin-1 bytes) of one text as this operator spells them, with their occurrences."""
    runs: Counter = Counter()
    for some in word_lists(text.encode("latin-1", "replace"), LETTERS):
        runs.update(some)
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    spelled: Counter = Counter()
    for run, n in runs.items():
        if len(run) >= LEAST_LENGTH:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
            if h % SPOILT == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= LEAST_LENGTH:
                spelled[run] += n
    return spelled


def count_words(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least ``least`` occurrences in all texts."""

    def rows(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.update(document_words(doc_id, text.as_py() or ""))
                if len(held) >= HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(per_batch, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def signatures(words: list[bytes], parts: int = PARTS) -> np.ndarray:
    """A row of signatures for each word (Latin-1 bytes): one for each choice of all parts but two."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(words)), lengths)
    place = of * 256 + letters
    place.sort()
    letters = place & 255
    begins = np.flatnonzero(np.diff(place, prepend=-1))
    number = np.arange(len(place)) - np.repeat(begins, np.diff(np.append(begins, len(place))))
    projections = np.zeros((len(words), parts), np.uint64)
    np.add.at(projections, (of, (letters + 3 * number) % parts), mixed((letters << 32 | number).astype(np.uint64)))
    choices = np.array(list(itertools.combinations(range(parts), parts - 2)))
    keys = np.zeros((len(words), len(choices)), np.uint64)
    for k, choice in enumerate(choices):
        for part in choice:
            keys[:, k] = mixed(keys[:, k] ^ projections[:, part])
        keys[:, k] = mixed(keys[:, k] + np.uint64(k))
    return keys


def signature_table(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """key, word: every signature of every word."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = signatures([w.encode("latin-1") for w in batch.column(0).to_pylist()], parts)
                repeated = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(repeated)], names=["key", "word"])

    return words.select("word").mapInArrow(per_batch, "key long, word string")


def _verified(keyed: DataFrame) -> DataFrame:
    """a, b (a before b): pairs of words under one key that one edit makes equal."""
    left, right = keyed.select("key", F.col("word").alias("a")), keyed.select("key", F.col("word").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, (left["key"] == right["key"]) & near).select("a", "b")


def near_pairs(words: DataFrame, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """a, b (a before b): all pairs of distinct words that differ by exactly one edit."""
    keys = stored(signature_table(words, parts))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(sizes, "key"))
    few = members.where(F.col("size") <= bucket).select("key", "word")
    crowded = members.where(F.col("size") > bucket).select("word").distinct()
    less = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda k: F.concat(F.substring(F.col("word"), F.lit(1), k - 1), F.substring(F.col("word"), k + 1, F.char_length("word"))))
    spelled = crowded.select(F.explode(F.array_distinct(F.concat(F.array("word"), less))).alias("spelling"), "word")
    return _verified(few).unionByName(_verified(spelled.select(F.xxhash64("spelling").alias("key"), "word"))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of each word end, from (word, form)."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus."""
    words = stored(count_words(docs))
    pairs = near_pairs(words, parts, bucket)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    often = -F.col("best.less") >= RATIO * F.col("n")
    found = stored(
        words.join(best, "word", "left").select(
            "word", F.when(often, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, -F.col("best.less")).alias("form_n")
        )
    )
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
