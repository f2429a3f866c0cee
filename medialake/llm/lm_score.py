"""Cross-entropy difference of matched n-gram models (operator 9).

Target and background models are word bigrams with back-off to unigrams over one shared vocabulary.
The background is every document, the target the documents that a label marks. All counts cover all
documents: words and bigrams are counted in tasks and summed by shuffles, and what is counted
grows with the corpus. A word or bigram has an entry if it occurs ``WORD_COUNT`` or ``BIGRAM_COUNT`` times, at any
size of the corpus; other words are one unknown word, other bigrams are backed off.

A token's loss is the sum of its word's loss, its context's back-off and, where the bigram has an entry, a
correction. A document's loss is therefore a sum of entries, one for each of its words and bigrams. The losses of the
``TOP`` most frequent words, which is a bound on their number, are broadcast. All other entries are made where they are
counted: each slice of texts sends its distinct bigrams, with the documents that hold them, once and packed to parts by
the last word; a part counts them over all slices and sends each slice one sum a document. So nothing is looked up, no
model is kept, and a token moves about 9 bytes whatever the size of the corpus. Bigrams of hot words are dealt to parts by
both words, and a part counts a bigram once a slice, however many documents hold it.
The score is the mean over a document's tokens (an end sign included) of target loss less background loss, in nats:
lower is more like the target.

Defined results: a null or empty text is one end sign; documents without a label, or with a null one,
are background only; a document with several labels is target if any marks it; rows that repeat count
once each and get equal scores; null doc_ids are kept and are background; without target documents
every target count is zero; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.membership import packed_by_ids
from medialake.llm.tokens import slices
from medialake.plans.shared import discard, stored

#: Fewest occurrences for an entry, so that no document is scored by entries that it made alone.
WORD_COUNT = 5
BIGRAM_COUNT = 5
#: Weight of the unigram in each bigram context.
BACK_OFF = 2.0
#: Most words whose losses are broadcast.
TOP = 1_000_000
#: Tokens of the corpus for each part of the bigrams, which a task gets packed, and least number of parts.
PART_TOKENS = 12_000_000
LEAST_PARTS = 16
#: Steps in which a task unpacks and counts its part.
STEPS = 4
#: Bits of a context's hash beside its last word's 64.
CONTEXT = (1 << 48) - 1
#: The sign that begins and ends a text, as a word's hash.
EDGE = 1

#: Packed columns of a part's bigrams in a slice: steps of the sorted routes, bigrams a route less one, context or hot word,
#: documents a bigram less one, documents, times in each less one.
PACKED = ["route", "runs", "other", "many", "docs", "times"]
SPLIT = f"part long, step int, slice long, hot boolean, {', '.join(f'{c} binary' for c in PACKED)}, marks binary, ids array<long>, n_tokens array<long>, target array<double>, background array<double>"
LOSSES = "part long, slice long, ids array<long>, n_tokens array<long>, at array<int>, target array<double>, background array<double>"
ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
SPLIT_NAMES, LOSS_NAMES = ([part.split()[0] for part in s.split(", ")] for s in (SPLIT, LOSSES))
SPLIT_TYPES, LOSS_TYPES = ([ARROW[part.split()[1]] for part in s.split(", ")] for s in (SPLIT, LOSSES))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hash(word: str | bytes) -> int:
    """64 bits of a word (signed)."""
    found = xxhash.xxh64_intdigest(word, 9)
    return found - (1 << 64) if found >> 63 else found


def bigram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits of two hashes in order."""
    mixed = context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ mixed >> np.uint64(32)).view(np.int64)


def _read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, hashes of the distinct words, number of each word among them)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = parts.offsets.to_numpy()
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    counts = np.diff(before[offsets - offsets[0]])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    hashes = np.fromiter(map(word_hash, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return counts, hashes, coded.indices.to_numpy().astype(np.int64)


def _bigrams(counts: np.ndarray, hashes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) of every token by number; an edge, which ends each text too, has the number after the last word."""
    ends = np.cumsum(counts)
    edge = len(hashes)
    return np.insert(codes, ends - counts, edge), np.insert(codes, ends, edge)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, marks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for first, rows in slices(texts):
            counts, hashes, codes = _read(texts.slice(first, rows))
            _, word = _bigrams(counts, hashes, codes)
            target = np.repeat(marks[first : first + rows], counts + 1)
            sums = [np.bincount(w, minlength=len(hashes) + 1).astype(np.int64) for w in (word, word[target])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.append(hashes, EDGE), *sums)], names=["key", "n", "t"])


def _with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, target of every document; only texts whose id a filter takes for a target's are moved, and once."""
    marked = labels.where(F.col("target")).select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some, others = packed_by_ids(texts, F.col("doc_id"), marked)
    met = some.join(marked.withColumn("target", F.lit(True)), "id", "left").select("own.*", F.coalesce("target", F.lit(False)).alias("target"))
    return stored(met, compression="zstd").unionByName(others.select("own.*", F.lit(False).alias("target")))


def _most_frequent(words: DataFrame, most: int) -> int:
    """The least count of words to broadcast, so that at most ``most`` of them have it."""
    grade = F.floor(F.log2("n") * 8).cast("int")
    left = most
    least = 1 << 62
    for row in words.groupBy(grade.alias("grade")).agg(F.count("*").alias("many"), F.min("n").alias("least")).orderBy(F.desc("grade")).collect():  # at most 8 rows for each doubling of n
        left -= row["many"]
        if left < 0:
            break
        least = row["least"]
    return least


@dataclass(frozen=True)
class Sizes:
    """What the models need besides counts: (target, background) sums over the corpus and the least counts of entries."""

    tokens: tuple[int, int]
    unknown: tuple[float, float]
    words: int
    word_count: int
    bigram_count: int

    def share(self, k: int, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.tokens[k] + self.words)

    def word_loss(self, k: int, count: np.ndarray) -> np.ndarray:
        """Loss and back-off of words less the unknown word's loss."""
        return -np.log(self.share(k, count)) - np.log(BACK_OFF / (count + BACK_OFF)) - self.unknown[k]

    def bigram_loss(self, k: int, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Corrections of bigrams by their counts and their last words'."""
        return -np.log1p(count / (BACK_OFF * self.share(k, word)))


def packed(x: np.ndarray) -> bytes:
    """Numbers from zero up, byte by byte of all of them, each byte compressed apart."""
    wide = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 0
    bytes_of = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    parts = [pa.compress(bytes_of[k], codec="zstd", asbytes=True) for k in range(wide)]
    return np.array([len(x), wide, *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpacked(data: bytes) -> np.ndarray:
    n, wide = np.frombuffer(data, "<u4", 2).tolist()
    at, found = 8 + 4 * wide, np.zeros((n, 8), np.uint8)
    for k, size in enumerate(np.frombuffer(data, "<u4", wide, 8).tolist()):
        found[:, k] = np.frombuffer(pa.decompress(data[at : at + size], n, codec="zstd"), np.uint8)
        at += size
    return found.view("<u8").ravel()


def _place(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The place of each of ``of`` in the sorted ``keys``, -1 where it is not among them."""
    if not len(keys):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, at, -1)


def _occurrences(parts: int, hot: np.ndarray, pairs: np.ndarray, docs: np.ndarray, times: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
    """(step of a part, hot, packed columns of ``PACKED``) of the bigrams of a slice: ``pairs`` (last word, context) and ``docs``, in order.

    Bigrams go to a part by their last word, so that its count is there too; those of a hot word by both words.
    """
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    many = np.diff(np.append(starts, len(pairs)))
    word, context = np.divmod(pairs[starts], len(own))
    place = _place(hot, own)[word]
    route = np.where(place >= 0, bigram_key(own[context], own[word]), own[word]).view(np.uint64)
    other = np.where(place >= 0, place, own[context] & CONTEXT)
    for is_hot in (False, True):
        some = np.flatnonzero((place >= 0) == is_hot)
        some = some[np.argsort(route[some], kind="stable")]
        key, lens = route[some], many[some]
        ends = np.cumsum(lens)
        each = np.repeat(starts[some] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)
        own_docs, own_times = docs[each], times[each] - 1
        step = (key >> np.uint64(32)) * np.uint64(parts * STEPS) >> np.uint64(32)
        cuts = np.searchsorted(step, np.arange(parts * STEPS + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            lo, hi = int(cuts[p]), int(cuts[p + 1])
            a, b = int(ends[lo] - lens[lo]), int(ends[hi - 1])
            runs = np.flatnonzero(np.append(True, np.diff(key[lo:hi]) != 0))
            first = key[lo:hi][runs]
            columns = (np.append(first[:1], np.diff(first)), np.diff(np.append(runs, hi - lo)) - 1, other[some[lo:hi]], lens[lo:hi] - 1, own_docs[a:b], own_times[a:b])
            yield p, is_hot, [packed(c) for c in columns]


def _split(parts: int, hot: Broadcast, frequent: Broadcast, adds: dict[str, tuple[float, float]]):
    """The task function that makes of each slice of texts a row of its documents, with the losses known there, and rows of its bigrams by part."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, (keys, *tables) = hot.value, frequent.value
        for batch in batches:
            texts, marks = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for first, rows in slices(texts):
                counts, hashes, codes = _read(texts.slice(first, rows))
                at = _place(keys, hashes)
                owner = np.repeat(np.arange(rows), counts)
                sums = [counts * adds["token"][k] + adds["document"][k] for k in (0, 1)]
                if len(keys):
                    sums = [s + np.bincount(owner, np.where(at >= 0, table[at], 0.0)[codes], minlength=rows) for s, table in zip(sums, tables, strict=True)]
                context, word = _bigrams(counts, hashes, codes)
                size = len(hashes) + 1
                found, times = np.unique((word * size + context) * rows + np.repeat(np.arange(rows), counts + 1), return_counts=True)
                slice_id = batch.column(0)[first].as_py()
                marked = np.packbits(marks[first : first + rows]).tobytes()
                made = [(*divmod(p, STEPS), slice_id, is_hot, *columns, marked, None, None, None, None) for p, is_hot, columns in _occurrences(parts, hot_keys, found // rows, found % rows, times, np.append(hashes, EDGE))]
                whole = (slice_id % parts, None, slice_id, None, *[None] * len(PACKED), marked, batch.column(1).slice(first, rows).to_pylist(), counts + 1, *sums)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(whole, *made, strict=True), SPLIT_TYPES, strict=True)], names=SPLIT_NAMES)

    return split


def _losses(rows: list[dict], is_hot: bool, sizes: Sizes, least: int, hot: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(documents, their losses by target and background) of each of the rows of a part."""
    routes, others, sums = [], [], ([], [])
    for row in rows:
        first, runs, many = np.cumsum(unpacked(row["route"])), unpacked(row["runs"]) + 1, unpacked(row["many"]) + 1
        docs, times = unpacked(row["docs"]).astype(np.int64), unpacked(row["times"]).astype(np.int64) + 1
        starts = (np.cumsum(many) - many).astype(np.int64)
        routes.append(np.repeat(first, runs.astype(np.int64)))
        others.append(unpacked(row["other"]))
        marks = np.unpackbits(np.frombuffer(row["marks"], np.uint8))
        for total, each in zip(sums, (times * marks[docs], times), strict=True):
            total.append(np.add.reduceat(each, starts))
    ends = np.cumsum([len(r) for r in routes])
    route, other, counts = np.concatenate(routes), np.concatenate(others), [np.concatenate(s) for s in sums]
    del routes, others, sums
    if is_hot:
        words = [hot[1 + k][other.astype(np.int64)] for k in (0, 1)]
        is_word = hot[0][other.astype(np.int64)] != EDGE
    else:
        _, place = np.unique(route, return_inverse=True)
        words = [np.bincount(place, c)[place] for c in counts]
        is_word = True
    _, place = np.unique(route if is_hot else bigram_key(other.view(np.int64), route.view(np.int64)), return_inverse=True)
    del route, other
    counts = [np.bincount(place, c) for c in counts]
    kept = np.flatnonzero((counts[1] >= sizes.bigram_count)[place])
    rest = np.flatnonzero((words[1] >= sizes.word_count) & (words[1] < least) & is_word)
    losses = [np.zeros(len(place)) for _ in (0, 1)]
    for k in (0, 1):
        losses[k][kept] += sizes.bigram_loss(k, counts[k][place[kept]], words[k][kept])
        losses[k][rest] += sizes.word_loss(k, words[k][rest])
    del place, counts, words
    some = np.zeros(len(losses[0]), bool)
    some[kept] = some[rest] = True
    for row, end in zip(rows, ends, strict=True):
        many = unpacked(row["many"]).astype(np.int64) + 1
        own = slice(end - len(many), end)
        met = np.repeat(some[own], many)
        docs, times = unpacked(row["docs"]).astype(np.int64)[met], unpacked(row["times"])[met] + 1.0
        at, of = np.unique(docs, return_inverse=True)
        yield at, [np.bincount(of, np.repeat(loss[own], many)[met] * times, minlength=len(at)) for loss in losses]


def _count(sizes: Sizes, least: int, hot: Broadcast):
    """The group function that counts the bigrams of a part over all slices and gives each slice its documents' losses."""

    def count(group: pa.Table) -> pa.Table:
        whole = group.filter(pc.is_valid(group["n_tokens"]))
        losses_of, part = {}, group["part"][0].as_py()
        for step, is_hot in itertools.product(range(STEPS), (False, True)):
            rows = group.filter(pc.and_(pc.equal(group["step"], step), pc.equal(group["hot"], is_hot))).select(["slice", *PACKED, "marks"]).sort_by("slice").to_pylist()
            for row, found in zip(rows, _losses(rows, is_hot, sizes, least, hot.value) if rows else (), strict=True):
                losses_of.setdefault(row["slice"], []).append(found)
        made = []
        for slice_id, found in losses_of.items():
            at, of = np.unique(np.concatenate([at for at, _ in found]), return_inverse=True)
            if len(at):
                made.append((part, slice_id, None, None, at, *[np.bincount(of, np.concatenate([losses[k] for _, losses in found])) for k in (0, 1)]))
        columns = zip(*made, strict=True) if made else [[]] * len(LOSS_NAMES)
        found = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, LOSS_TYPES, strict=True)], names=LOSS_NAMES)
        kept = [whole[c] if c != "at" else pa.nulls(len(whole), t) for c, t in zip(LOSS_NAMES, LOSS_TYPES, strict=True)]
        return pa.concat_tables([pa.Table.from_arrays(kept, names=LOSS_NAMES).cast(found.schema), found])

    return count


def _summed(group: pa.Table) -> pa.Table:
    """A row for each document of a slice."""
    whole = group.filter(pc.is_valid(group["n_tokens"])).to_pylist()[0]
    sums = [np.array(whole[c]) for c in ("target", "background")]
    for row in group.filter(pc.is_valid(group["at"])).sort_by("part").to_pylist():
        for total, c in zip(sums, ("target", "background"), strict=True):
            total[row["at"]] += row[c]
    n = np.array(whole["n_tokens"])
    return pa.table({"doc_id": pa.array(whole["ids"], pa.int64()), "n_tokens": n, "target_loss": sums[0] / n, "background_loss": sums[1] / n})


def score_documents(docs: DataFrame, labels: DataFrame, word_count: int = WORD_COUNT, bigram_count: int = BIGRAM_COUNT, top: int = TOP, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means in nats) and score (their difference).

    ``labels`` has doc_id and target (boolean).
    """
    if bigram_count < word_count:
        raise ValueError("a bigram's entry needs entries of its words: bigram_count must be word_count at least")
    context = docs.sparkSession.sparkContext
    texts = _with_target(docs, labels)
    words = stored(texts.select("text", "target").mapInArrow(_word_counts, "key long, n long, t long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))
    is_edge = F.col("key") == EDGE
    is_known = (F.col("n") >= word_count) & ~is_edge
    of = words.agg(
        *[F.sum(c).alias(f"all_{c}") for c in "nt"], *[F.sum(F.when(~is_known & ~is_edge, F.col(c))).alias(f"unknown_{c}") for c in "nt"],
        *[F.sum(F.when(is_edge, F.col(c))).alias(f"edge_{c}") for c in "nt"], F.count(F.when(is_known, True)).alias("known"),
    ).first()
    size = of["known"] + 2
    unknown, edge = [], []
    for c in "tn":
        total, back = (of[f"all_{c}"] or 0) + size, of[f"edge_{c}"] or 0
        unknown.append(-math.log(((of[f"unknown_{c}"] or 0) + 1) / total))
        edge.append(-math.log((back + 1) / total) - math.log(BACK_OFF / (back + BACK_OFF)))
    sizes = Sizes((of["all_t"] or 0, of["all_n"] or 0), tuple(unknown), size, word_count, bigram_count)
    known = words.where(is_known)
    least = _most_frequent(known, top)
    frequent = known.where(F.col("n") >= least).toArrow().sort_by("key")
    n_t = [frequent.column(c).to_numpy() for c in "tn"]
    shared = context.broadcast((frequent.column("key").to_numpy(), *[sizes.word_loss(k, n_t[k]) for k in (0, 1)]))
    often = words.where((F.col("n") > part_tokens // (8 * STEPS)) | is_edge).toArrow().sort_by("key")  # at most 8 a step of a part, and the edge
    hot = [often.column(c).to_numpy() for c in ("key", "t", "n")]
    discard(words)
    parts = max(LEAST_PARTS, -(-sizes.tokens[1] // part_tokens))
    rows = texts.select(F.monotonically_increasing_id().alias("slice"), "doc_id", "text", "target")
    split = rows.mapInArrow(_split(parts, context.broadcast(hot[0]), shared, {"token": tuple(unknown), "document": tuple(edge)}), SPLIT)
    # more partitions than parts, so that few tasks get two
    counted = split.repartition(4 * parts, "part").groupBy("part").applyInArrow(_count(sizes, least, context.broadcast(hot)), LOSSES)
    found = counted.groupBy("slice").applyInArrow(_summed, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))
