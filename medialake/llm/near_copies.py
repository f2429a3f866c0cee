"""One document of each group of near copies (operator 7 as a filtering step).

Two documents are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more. Documents with the same words in a row are one from the start. Operator 7's SimHash and Golay keys,
over the five-word shingles, propose pairs whose fingerprints differ in two bits at most; that finds
close copies at once but cannot find all at 0.8, whose fingerprints differ in about ten bits of 64. An
exact prefix filter finds the others: shingles have one order for all documents, rarest first, and of two
near copies the larger one's first n - 0.8 n + 1 shingles and the smaller one's first n - 2 * 0.8 / 1.8 n
+ 1 have one in common, so no pair is missed. The order comes from counts in a bounded sample; it decides
how many candidates there are, never which near copies are found. Candidates whose places in the order
leave too few shingles in common are dropped, and so are those whose bitmaps (a bit for each shingle's hash)
show too many shingles that the other has not, first on short bitmaps, then on longer ones (outlines) made of the texts of the
candidates; the others are verified on the shingles of their texts.

Only links that connect groups are wanted. Documents of a shingle that more than ``bucket`` share are therefore
first compared with one representative each, in rounds, until the pairs of documents that are not
connected yet are few or a round connects nothing; then those pairs are candidates, in salted parts. A crowded
shingle of near copies costs its documents a round, not its pairs; one of documents that share it without being
similar costs the pairs that the filters leave.

Defined results: null, empty and blank texts are copies of each other; texts of fewer than five words
have one shingle of all words; rows that share a doc_id are one document that is linked if one of its texts is
and goes if a link leads to a smaller id or all its texts are copies of smaller ids', and of which one row stays;
rows with a null doc_id all stay; an empty table gives an empty result; columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.llm import simhash
from medialake.llm.membership import packed_by_ids
from medialake.llm.tokens import batches_of, slices
from medialake.operators.graph import connected_components
from medialake.plans.shared import discard, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Documents of the sample whose shingle counts order all shingles, fewest of them for a count, and most shingles that get a count.
SAMPLE = 10_000
SAMPLE_COUNT = 3
ORDERED = 1_000_000
#: Documents of a shingle up to which all its pairs are candidates at once, documents of a salted part.
BUCKET = 6
PART = 1024
#: Rounds of representatives go on while more pairs than this are left for each row of a crowded shingle.
PAIRS_A_ROW = 8
ROUNDS = 12
#: A round that leaves more than this part of the pairs is the last.
PROGRESS = 0.75
#: 64-bit words of a document's bitmap of shingles.
WORDS = 8
BITMAP = [f"bits{k}" for k in range(WORDS)]
#: Bits of a candidate's outline, by which pairs are dropped before texts are moved.
OUTLINE = 4096


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text without words has one of its own."""
    found = np.unique(simhash.shingle_hashes(text or "", shingle))
    return found if len(found) else np.zeros(1, np.uint64)


def in_order(tokens: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(``tokens`` by their count in the sample, zero where they are not common, then by themselves; how many are not common)."""
    rank = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rank = np.where(common[at] == tokens, counts[at], 0)
    return tokens[np.lexsort((tokens, rank))], int((rank == 0).sum())


def prefix_size(n: int, least: float) -> int:
    """Shingles of ``n`` of which one is shared when ``least * n`` are."""
    return n - max(1, math.ceil(least * n - 1e-9)) + 1


def _sample_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, documents of the sample it stands in) of the shingles that are common there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                tokens, n = np.unique(np.concatenate([shingle_set(t.as_py()) for t in batch.column(0).slice(part, 64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    parts = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(parts)) == 0).select("text")
    counted = some.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_COUNT)
    common = counted.orderBy(F.desc("n"), "token").limit(ORDERED).toArrow()
    tokens, n = common.column("token").to_numpy().view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _distinct(texts: DataFrame, similarity: float) -> DataFrame:
    """A row for each row of words: first doc, n shingles, fp, prefix (in order) and how many of all shingles are ``rare``."""
    shared = texts.sparkSession.sparkContext.broadcast(_sample_counts(texts))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in slices(batch.column(1)):
                same, sizes, prints, rares, prefixes = [], [], [], [], []
                bitmaps = np.zeros((rows, 64 * WORDS), np.uint8)
                for row, text in enumerate(batch.column(1).slice(start, rows)):
                    words = text.as_py() or ""
                    same.append(xxhash.xxh3_128_digest(b" ".join(words.encode().lower().split())))
                    hashes = simhash.shingle_hashes(words, SHINGLE)
                    prints.append(simhash.bits_of(hashes))
                    own = np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)
                    bitmaps[row, (own % np.uint64(64 * WORDS)).astype(np.int64)] = 1
                    ordered, rare = in_order(own, *shared.value)
                    sizes.append(len(own))
                    rares.append(rare)
                    prefixes.append(ordered[: prefix_size(len(own), similarity)].astype(np.int64))  # a copy: the whole array can go
                ends = pa.array(np.concatenate([[0], np.cumsum(list(map(len, prefixes)))]).astype(np.int32))
                columns = [batch.column(0).slice(start, rows), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(rares, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes)))]
                columns += list(map(pa.array, np.packbits(bitmaps, axis=1).view(np.int64).T.copy()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "same", "n", "fp", "rare", "prefix", *BITMAP])
            pa.default_memory_pool().release_unused()

    found = texts.mapInArrow(read, "doc long, same binary, n int, fp long, rare int, prefix array<long>, " + ", ".join(f"{b} long" for b in BITMAP))
    first = found.groupBy("same").agg(F.min_by(F.struct("doc", "n", "fp", "rare", "prefix", *BITMAP), "doc").alias("first"))
    with batches_of(texts.sparkSession):
        return stored(first.select("first.*"))


def _least(share: float, n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(share * n - 1e-9))


def _indexed(similarity: float, n: str = "n", place: str = "place") -> Column:
    """Whether a place belongs to the prefix for partners of its document's size or more."""
    return F.col(place) < F.col(n) - _least(2 * similarity / (1 + similarity), F.col(n)) + 1


def _shared(distinct: DataFrame, similarity: float) -> DataFrame:
    """(token, doc, n, place, count) of prefix shingles that several documents have, ``count`` of them.

    Shingles that are not common in the sample are counted by a window over one shuffle; common ones, which may be
    in any part of the documents, by partial sums and a join that can be split.
    """
    rows = distinct.select("doc", "n", "rare", F.posexplode("prefix").alias("place", "token"))
    columns = ["token", "doc", "n", "place"]
    own = Window.partitionBy("token")
    few = rows.where("place < rare").select(*columns).withColumns({"count": F.count("*").over(own), "any": F.max(_indexed(similarity)).over(own)})
    common = rows.where("place >= rare").select(*columns)
    counts = common.groupBy("token").agg(F.count("*").alias("count"), F.max(_indexed(similarity)).alias("any"))
    return stored(few.unionByName(common.join(counts, "token")).where("count > 1 and any").drop("any"))


def _overlap(similarity: float) -> Column:
    """Shingles that near copies of n_a and n_b have in common at least."""
    return similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6


def _bitmaps_allow(similarity: float) -> Column:
    """Whether few enough bits of each side are missing on the other."""

    def own(of: str, other: str) -> Column:
        return sum((F.bit_count(F.col(f"{b}_{of}").bitwiseAND(F.bitwise_not(f"{b}_{other}"))) for b in BITMAP[1:]), F.bit_count(F.col(f"{BITMAP[0]}_{of}").bitwiseAND(F.bitwise_not(f"{BITMAP[0]}_{other}"))))

    return (F.col("n_a") - own("a", "b") >= _overlap(similarity)) & (F.col("n_b") - own("b", "a") >= _overlap(similarity))


def _allowed(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, whose sizes and bitmaps allow the similarity."""
    close = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = [distinct.select(F.col("doc").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", *BITMAP)]) for side in "ab"]
    return close.join(sides[0], "a").join(sides[1], "b").where(_bitmaps_allow(similarity)).select("a", "b").distinct()


def _met(left: DataFrame, right: DataFrame, on: list[str], similarity: float, more: list[str]) -> DataFrame:
    """Pairs (a, b), b no larger than a, that meet at a shingle after which enough can still be common.

    ``more``: columns of both sides; with a group only pairs between groups, with bitmaps only those that they allow.
    """
    a = left.select(*on, *[F.col(c).alias(f"{c}_a") for c in ["doc", "n", "place", *more]])
    b = right.where(_indexed(similarity)).select(*on, *[F.col(c).alias(f"{c}_b") for c in ["doc", "n", "place", *more]])
    met = a.join(b, on).where("(n_a > n_b or n_a = n_b and doc_a < doc_b) and doc_a <> doc_b").where(F.col("n_b") >= similarity * F.col("n_a") - 1e-6)
    if "group" in more:
        met = met.where("group_a <> group_b")
    both = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    met = met.where(both >= _overlap(similarity))
    if BITMAP[0] in more:
        met = met.where(_bitmaps_allow(similarity))
    return met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()


def _stars(crowded: DataFrame, round_: int, similarity: float) -> DataFrame:
    """Pairs of documents of crowded shingles with the representative of the shingle."""
    heads = crowded.groupBy("token").agg(F.min_by(F.struct("doc", "n", "place", "group"), F.xxhash64("doc", F.lit(round_))).alias("head")).select("token", "head.*")
    return _met(crowded, heads, ["token"], similarity, ["group"]).unionByName(_met(heads, crowded, ["token"], similarity, ["group"]))


def _simhash_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents that operator 7 links: same fingerprints with their first document, near ones by their first documents."""
    prints = stored(distinct.groupBy("fp").agg(F.min("doc").alias("head")))
    same = distinct.join(prints, "fp").where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b"))
    linked = simhash.links(prints).join(prints.select(F.col("fp").alias("a"), F.col("head").alias("ha")), "a").join(prints.select(F.col("fp").alias("b"), F.col("head").alias("hb")), "b")
    return same.unionByName(linked.select(F.col("ha").alias("a"), F.col("hb").alias("b")))


def _outlines(own: DataFrame) -> DataFrame:
    """doc, n shingles and a bitmap of ``OUTLINE`` bits of each text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, outlines = [], []
            for text in batch.column(1):
                tokens = shingle_set(text.as_py())
                bits = np.zeros(OUTLINE, np.uint8)
                bits[(tokens % np.uint64(OUTLINE)).astype(np.int64)] = 1
                sizes.append(len(tokens))
                outlines.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(outlines, pa.binary())], names=["doc", "n", "outline"])
            pa.default_memory_pool().release_unused()

    return own.mapInArrow(read, "doc long, n long, outline binary")


def _outlines_allow(close: DataFrame, outlines: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of which two texts have outlines that allow the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(c).to_numpy() for c in (2, 3))
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
                only_a, only_b = (np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((a, b), (b, a)))
                allowed = np.minimum(n_a - only_a, n_b - only_b) >= similarity / (1 + similarity) * (n_a + n_b) - 1e-6
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(allowed))

    a, b = (outlines.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("outline").alias(f"outline_{side}")) for side in "ab")
    met = close.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "outline_a", "outline_b")
    return met.mapInArrow(compare, "a long, b long").distinct()


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, text of documents in ``pairs`` (and of few others, as a filter lets them pass), in place: no text is moved."""
    involved = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    return packed_by_ids(texts, F.col("doc"), involved)[0].select("own.doc", "own.text")


def _verified(pairs: DataFrame, distinct: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches ``similarity``.

    Only texts of documents in pairs are read again, and only those are moved whose outlines allow the similarity: once by
    their document, which serves both sides, and once to each of their pairs.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, np.zeros(0)
            for one, other in zip(batch.column(2), batch.column(3)):
                if last is None or one != last:
                    last, x = one, shingle_set(one.as_py())
                y = shingle_set(other.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()

    close = stored(_allowed(pairs, distinct, similarity))
    with batches_of(texts.sparkSession):
        own = stored(_texts_of(close, texts))
        outlines = stored(_outlines(own))
        closer = stored(_outlines_allow(close, outlines, similarity))
        # One row for each text of a document, however often it is repeated.
        moved = _texts_of(closer, own).repartition("doc").dropDuplicates(["doc", "text"])
        joined = closer.join(moved.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b").join(moved.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
        found = stored(joined.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long"))
    discard(close, own, outlines, closer)
    return found


def _unconnected(crowded: DataFrame, links: DataFrame) -> tuple[DataFrame, float]:
    """(rows of crowded shingles whose documents are not all connected, with their ``group``; pairs left for each row)."""
    groups = connected_components(links, "a", "b").select(F.col("node").alias("doc"), "component")
    named = stored(crowded.drop("group").join(groups, "doc", "left").withColumn("group", F.coalesce("component", "doc")).drop("component"))
    sizes = named.groupBy("token", "group").agg(F.count("*").cast("double").alias("own")).groupBy("token").agg(F.sum("own").alias("all"), F.sum(F.col("own") * F.col("own")).alias("inside"), F.count("*").alias("groups"))
    several = stored(sizes.where("groups > 1"))
    rows, pairs = several.agg(F.sum("all"), F.sum((F.col("all") * F.col("all") - F.col("inside")) / 2)).first()
    return stored(named.join(several.select("token"), "token")), (pairs or 0.0) / max(rows or 0.0, 1.0)


def near_copy_links(texts: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(first documents of each row of words, links (a, b) that connect all near copies among them). ``texts`` has doc and text."""
    distinct = _distinct(texts, similarity)
    members = _shared(distinct, similarity)
    small, crowded = members.where(F.col("count") <= bucket), members.where(F.col("count") > bucket).withColumn("group", F.col("doc"))
    links = _verified(_met(small, small, ["token"], similarity, []).unionByName(_stars(crowded, 0, similarity)).unionByName(_simhash_pairs(distinct)), distinct, texts, similarity)
    rest, left = _unconnected(crowded, links)
    for round_ in range(1, ROUNDS):
        if left <= PAIRS_A_ROW:
            break
        found = _verified(_stars(rest, round_, similarity), distinct, texts, similarity)
        links, before = links.unionByName(found), left
        rest, left = _unconnected(rest, links)
        if left > PROGRESS * before:
            break
    parts = rest.join(distinct.select("doc", *BITMAP), "doc").withColumn("parts", F.ceil(F.col("count") / PART).cast("int"))
    probes = parts.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    index = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return distinct.select("doc"), links.unionByName(_verified(_met(probes, index, ["token", "part"], similarity, ["group", *BITMAP]), distinct, texts, similarity))


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with only the smallest doc_id of each group of near copies."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    firsts, links = near_copy_links(texts, similarity, bucket)
    groups = connected_components(links, "a", "b")
    later = groups.where(F.col("node") != F.col("component")).select(F.col("node").alias("doc"))
    counted = texts.groupBy("doc").agg(F.count("*").alias("rows"))
    kept = firsts.distinct().join(later, "doc", "left_anti").withColumn("kept", F.lit(True))
    # Ids that go, or of which one row stays: only their rows are moved.
    moved = stored(counted.join(kept, "doc", "left").where("kept is null or rows > 1").select("doc", "kept"))
    some, others = packed_by_ids(docs, docs["doc_id"], moved.select("doc"))
    met = some.join(moved.select(F.col("doc").alias("id"), F.coalesce("kept", F.lit(False)).alias("kept"), F.lit(True).alias("moved")), "id", "left")
    untouched = others.select("own").unionByName(met.where("moved is null").select("own"))
    return untouched.unionByName(met.where("kept").dropDuplicates(["id"]).select("own")).select("own.*")
