"""A stored positional trigram index and ranked search over it.

Documents are cut into blocks of at most ``BLOCK_DOCS`` rows and about ``BLOCK_CHARS`` characters. A row of
the index is one trigram in one block: in which documents and at which places of which field it stands, the largest
weighted count in a document, and the block's shortest document. Rows are written in folders by ``bucket`` of the gram and
sorted by gram within files, so that a search reads the folders and row groups of its own grams only.

A term of at least three characters is covered by the grams at 0, 3, 6 ... and at its end; it stands where all of
them stand at their distances, overlapping ones included. Wanted rows are gathered by block, each block finds all terms
at once, and exact counts of documents by term follow from these hits. Ranking then is one pass over the
hits of the blocks, with the k best of each query held in the task: a block whose maxima bound a query's score below its kth is passed
over, and only k rows a query and task are shuffled.

Fields are compared in lower case; null fields are empty. A term of fewer than three characters is found
nowhere. Rows that share an id count each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.operators.rank import B, GRAM, K1, LEAST_IDF, WEIGHTS, document_size
from medialake.plans.shared import stored

BLOCK_DOCS = 4096
BLOCK_CHARS = 1 << 21
#: Folders of the index, and the one of the blocks' documents.
BUCKETS = 32
DOCS = -1
#: In the place of an id whose document is no more.
VOID = -(1 << 63)
#: Terms that one pass over the index looks for.
TERMS = 50_000
#: Grams up to which the scan filters by a list; beyond it wanted grams are joined.
LISTED = 5_000
_INDEX = "bucket int, block long, gram long, most double, shortest long, docs binary, places binary"
_WEIGHTS = np.array([*WEIGHTS.values(), 0.0])


@dataclass(frozen=True)
class Postings:
    """``grams``: rows of ``_INDEX``; ``blocks``: block, ids, sizes; total rows and mean size of those that are not void; number of segments."""

    grams: DataFrame
    blocks: DataFrame
    total: int
    mean: float
    segments: int = 1


def gram_keys(points: np.ndarray) -> np.ndarray:
    """A number for each three neighbouring code points."""
    p = points.astype(np.int64)
    return p[:-2] << 42 | p[1:-1] << 21 | p[2:]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def covering(term: str) -> list[tuple[int, int]]:
    """(gram, place) of the grams that together hold every character of a term."""
    keys = gram_keys(_points(term))
    last = len(keys) - 1
    return [(int(keys[at]), at) for at in sorted({*range(0, len(keys), GRAM), last})]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams ^ grams >> 21 ^ grams >> 42) % BUCKETS


def _places(fields: list[list[str | None]], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, owner, place, begin): every trigram of a block's texts, of ``only`` (sorted) if given, by gram, document and place; where each gram begins."""
    keys, owners, places = [], [], []
    for number, texts in enumerate(fields):
        lengths = np.array([len(t or "") for t in texts], np.int64)
        points = _points("".join(t or "" for t in texts))
        if len(points) < GRAM:
            continue
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(points)) - begins[owner]
        whole = np.flatnonzero(at + GRAM <= lengths[owner])
        key = gram_keys(points)[whole]
        if only is not None:
            wanted = only[np.minimum(np.searchsorted(only, key), len(only) - 1)] == key
            whole, key = whole[wanted], key[wanted]
        keys.append(key)
        owners.append(owner[whole])
        places.append(at[whole] * 8 + number)
    gram, owner, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, owners, places))
    order = np.lexsort((owner << 32 | place, gram))
    return gram[order], owner[order], place[order], np.flatnonzero(np.diff(gram[order], prepend=-1))


def _block_rows(block: int, ids: list, sizes: np.ndarray, fields: list[list[str | None]]) -> pa.RecordBatch:
    """Index rows of one block of documents, with the row of its ids and sizes."""
    gram, owner, place, begin = _places(fields)
    runs = np.flatnonzero(np.diff(gram, prepend=-1) | np.diff(owner, prepend=-1))
    weight = np.add.reduceat(_WEIGHTS[place & 7], runs) if len(runs) else np.zeros(0)
    most = np.maximum.reduceat(weight, np.searchsorted(runs, begin)) if len(runs) else np.zeros(0)
    end = np.append(begin[1:], len(gram))
    docs, where = owner.astype("<u2"), place.astype("<u4")
    n = len(begin)
    grams = gram[begin]
    columns = [
        pa.array(np.append(_bucket(grams), DOCS), pa.int32()), pa.array([block] * (n + 1), pa.int64()), pa.array(np.append(grams, 0), pa.int64()), pa.array(np.append(most, 0.0)),
        pa.array([int(sizes.min())] * (n + 1), pa.int64()),
        pa.array([docs[a:b].tobytes() for a, b in zip(begin, end)] + [np.array(ids, "<i8").tobytes()], pa.binary()),
        pa.array([where[a:b].tobytes() for a, b in zip(begin, end)] + [sizes.astype("<i8").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "gram", "most", "shortest", "docs", "places"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list]]:
    """(ids, sizes, fields) of the blocks of a partition."""
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        blocks = np.maximum(np.cumsum(sizes + 1) // BLOCK_CHARS, np.arange(len(sizes)) // BLOCK_DOCS)
        for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(blocks)) + 1):
            for begin in range(0, len(part), BLOCK_DOCS):
                some = batch.slice(part[begin], len(part[begin : begin + BLOCK_DOCS]))
                if some.num_rows:
                    yield some.column("id").to_pylist(), some.column("size").to_numpy(zero_copy_only=False), [some.column(f).to_pylist() for f in WEIGHTS]


def _index_rows(batches: Iterator[pa.RecordBatch], segment: int = 0) -> Iterator[pa.RecordBatch]:
    first = segment << 52 | TaskContext.get().partitionId() << 32
    for number, block in enumerate(_blocks(batches)):
        yield _block_rows(first + number, *block)


def _searched(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("id").cast("long").alias("id"), document_size().cast("long").alias("size"), *[F.lower(f).alias(f) for f in WEIGHTS])
    return rows.where("id is not null")


def _segment(docs: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(grams, blocks) of some documents, written once."""
    found = _searched(docs).mapInArrow(functools.partial(_index_rows, segment=number), _INDEX)
    # Each task writes the folders of its own blocks: rows of the index are never shuffled, and no task holds all of a gram.
    index = stored(found.sortWithinPartitions("bucket", "gram", "block"), by="bucket", compression="zstd")
    return index.where(F.col("bucket") != DOCS), index.where(F.col("bucket") == DOCS).select("block", F.col("docs").alias("ids"), F.col("places").alias("sizes"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = size = 0
    for batch in batches:
        for ids, sizes in zip(batch.column("ids").to_pylist(), batch.column("sizes").to_pylist()):
            alive = np.frombuffer(ids, "<i8") != VOID
            n, size = n + int(alive.sum()), size + int(np.frombuffer(sizes, "<i8")[alive].sum())
    yield pa.RecordBatch.from_pydict({"n": [n], "size": [size]}, pa.schema([("n", pa.int64()), ("size", pa.int64())]))


def _postings(grams: DataFrame, blocks: DataFrame, segments: int) -> Postings:
    sums = blocks.select("ids", "sizes").mapInArrow(_sums, "n long, size long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return Postings(grams, blocks, sums["n"], sums["size"] / sums["n"] if sums["n"] and sums["size"] else 1.0, segments)


def build_postings(docs: DataFrame) -> Postings:
    """The index of ``docs`` (id and the searched fields), written once into the shared folder."""
    return _postings(*_segment(docs, 0), 1)


def _grams_of(terms: list[str]) -> np.ndarray:
    return np.unique(np.array([-1, *(g for t in terms for g, _ in covering(t))], np.int64))


def update_postings(index: Postings, gone: DataFrame, docs: DataFrame) -> Postings:
    """The index without the documents of the ids ``gone`` (id) and with ``docs``, whose older rows go as well.

    New documents are a segment of their own. Of older segments only the lists of documents of the blocks that hold such an id
    are written again, with the id void; their grams stay as they are and void documents are passed over.
    Every search reads all segments: build anew after some dozens.
    """
    ids = gone.select("id").unionByName(docs.select("id")).distinct()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row) // 8, block)), pa.array(np.arange(len(row) // 8)), pa.array(np.frombuffer(row, "<i8"))], names=["block", "at", "id"])

    dead = index.blocks.select("block", "ids").mapInArrow(held, "block long, at long, id long").join(ids, "id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("at"))

    def void(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for row, at in zip(batch.column("ids").to_pylist(), batch.column("at").to_pylist()):
                own = np.frombuffer(row, "<i8").copy()
                own[at or []] = VOID
                names.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(names, pa.binary()), batch.column("sizes")], names=["block", "ids", "sizes"])

    touched = stored(index.blocks.join(dead, "block").mapInArrow(void, index.blocks.schema))
    grams, blocks = _segment(docs, index.segments)
    kept = index.blocks.join(touched.select("block"), "block", "left_anti")
    return _postings(index.grams.unionByName(grams), stored(kept.unionByName(touched).unionByName(blocks)), index.segments + 1)


def wanted_grams(index: Postings, terms: list[str]) -> DataFrame:
    """The index rows of the grams that cover ``terms``; folders and row groups without them are not read."""
    keys = _grams_of(terms)
    found = index.grams.where(F.col("bucket").isin(sorted({int(b) for b in _bucket(keys)})))
    if len(keys) <= LISTED:
        return found.where(F.col("gram").isin(keys.tolist()))
    spark = index.grams.sparkSession
    return found.join(spark.createDataFrame([(int(k),) for k in keys], "gram long"), "gram", "left_semi")


def _covers(terms: list[str]) -> dict[int, list]:
    """Numbers of terms and their covering grams by the first of these."""
    by_gram: dict[int, list] = {}
    for n, term in enumerate(terms):
        cover = covering(term)
        by_gram.setdefault(cover[0][0], []).append((n, cover))
    return by_gram


def _found(covers: dict[int, list], held: dict[int, np.ndarray], alive: np.ndarray) -> dict[str, list]:
    """The terms that a block holds: number, documents, their weighted counts, how many, the largest count. ``held``: sorted owner << 32 | place by gram."""
    out: dict = {"term": [], "docs": [], "counts": [], "n": [], "most": []}
    for gram, places in held.items():
        for n, cover in covers.get(gram, ()):
            met = places
            for other, at in cover[1:]:
                met = np.intersect1d(met, held[other] - 8 * at, assume_unique=True) if other in held and len(met) else met[:0]
            met = met if alive.all() else met[alive[met >> 32]]
            if len(met):
                docs, first = np.unique(met >> 32, return_index=True)
                counts = np.add.reduceat(_WEIGHTS[met & 7], first)
                for c, v in zip(out, (n, docs.astype("<u2").tobytes(), counts.tobytes(), len(docs), counts.max())):
                    out[c].append(v)
    return out


def term_hits(index: Postings, terms: list[str]) -> DataFrame:
    """A row for each block with its ids and sizes and, by number of the term, the documents that hold it and its weighted counts there."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers = _covers(terms)
        for batch in batches:
            for row in batch.to_pylist():
                held = {r["gram"]: np.frombuffer(r["docs"], "<u2").astype(np.int64) << 32 | np.frombuffer(r["places"], "<u4") for r in row["rows"]}
                out = _found(covers, held, np.frombuffer(row["ids"], "<i8") != VOID)
                if out["term"]:
                    yield pa.RecordBatch.from_pylist([{c: row[c] for c in ("ids", "sizes", "shortest")} | out], _HITS)

    rows = wanted_grams(index, terms).groupBy("block").agg(F.collect_list(F.struct("gram", "docs", "places")).alias("rows"), F.min("shortest").alias("shortest"))
    return rows.join(index.blocks, "block").select("rows", "shortest", "ids", "sizes").mapInArrow(meet, _HITS_SCHEMA)


def text_hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of ``term_hits`` for documents without an index: each block is indexed in its task, by the terms' grams only, and its hits leave."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers, only = _covers(terms), _grams_of(terms)
        for ids, sizes, fields in _blocks(batches):
            gram, owner, place, begin = _places(fields, only)
            held = {int(gram[a]): owner[a:b] << 32 | place[a:b] for a, b in zip(begin, np.append(begin[1:], len(gram)))}
            out = _found(covers, held, np.ones(len(ids), bool))
            if out["term"]:
                row = {"ids": np.array(ids, "<i8").tobytes(), "sizes": sizes.astype("<i8").tobytes(), "shortest": int(sizes.min()), **out}
                yield pa.RecordBatch.from_pylist([row], _HITS)

    return _searched(docs).mapInArrow(meet, _HITS_SCHEMA)


_HITS_SCHEMA = "ids binary, sizes binary, shortest long, term array<int>, docs array<binary>, counts array<binary>, n array<long>, most array<double>"
_HITS = pa.schema([
    ("ids", pa.binary()), ("sizes", pa.binary()), ("shortest", pa.int64()), ("term", pa.list_(pa.int32())), ("docs", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())),
    ("most", pa.list_(pa.float64())),
])


def _idf(total: int, having: np.ndarray) -> np.ndarray:
    value = np.log((total - having + 0.5) / (having + 0.5))
    return np.where(value > 0, value, LEAST_IDF)


def _part(idf: float, count: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return idf * count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))


def _ranked(hits: DataFrame, queries: list[tuple[int, list[int]]], idf: dict[int, float], mean: float, k: int | None) -> DataFrame:
    """(query_id, id, score): the k best rows of each query and partition, all of them if k is None."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = (np.frombuffer(row[c], "<i8") for c in ("ids", "sizes"))
                at = {t: j for j, t in enumerate(row["term"])}
                docs, counts = ([np.frombuffer(x, kind) for x in row[c]] for c, kind in (("docs", "<u2"), ("counts", "<f8")))
                bound = {t: float(_part(idf[t], np.float64(row["most"][j]), np.float64(row["shortest"]), mean)) for t, j in at.items()}
                found: list = [[], [], []]
                for query, terms in queries:
                    if not all(t in at for t in terms):
                        continue
                    best = held.get(query)
                    if best and len(best[0]) == k and sum(bound[t] for t in terms) + 1e-9 < -best[0][-1]:
                        continue
                    rows = functools.reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted((docs[at[t]] for t in terms), key=len))
                    score = np.zeros(len(rows))
                    for t in terms:
                        score -= _part(idf[t], counts[at[t]][np.searchsorted(docs[at[t]], rows)], sizes[rows], mean)
                    if k is None:
                        found = [[*found[0], np.full(len(rows), query)], [*found[1], ids[rows]], [*found[2], score]]
                    else:
                        old = best or (np.zeros(0), np.zeros(0, np.int64))
                        score, names = np.concatenate([old[0], score]), np.concatenate([old[1], ids[rows]])
                        first = np.lexsort((names, np.round(score, 9)))[:k]
                        held[query] = score[first], names[first]
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["query_id", "id", "score"])
        for query, (score, names) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), query)), pa.array(names), pa.array(score)], names=["query_id", "id", "score"])

    return hits.mapInArrow(rank, "query_id long, id long, score double")


def _search(hits_of, total: int, mean: float, queries: list[tuple[int, list[str]]], k: int | None) -> DataFrame:
    """``_ranked`` for queries of lower-case terms of three characters or more; ``hits_of`` gives the hits of a list of terms."""
    terms = sorted({t for _, of in queries for t in of})
    number = {t: n for n, t in enumerate(terms)}
    hits = stored(hits_of(terms))
    having = hits.select(F.explode(F.arrays_zip("term", "n")).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n")).collect()
    idf = {r["term"]: float(_idf(total, np.float64(r["n"]))) for r in having}
    return _ranked(hits, [(q, [number[t] for t in of]) for q, of in queries], idf, mean, k)


def rank_by_postings(index: Postings, terms: list[str] | tuple[str, ...]) -> DataFrame:
    """(id, score) of the rows that hold all terms; lower is better. Repeated terms count as often as they stand."""
    low = [t.lower() for t in terms]
    if not low or min(map(len, low)) < GRAM:
        return index.grams.sparkSession.createDataFrame([], "id long, score double")
    return _search(functools.partial(term_hits, index), index.total, index.mean, [(0, low)], None).select("id", "score")


def _asked(queries: DataFrame) -> DataFrame:
    low = F.filter(F.array_distinct(F.transform("terms", lambda t: F.lower(t))), lambda t: F.char_length(t) >= GRAM)
    return queries.select(F.col("query_id").cast("long").alias("query_id"), low.alias("terms")).where(F.size("terms") > 0)


def _batches(hits_of, total: int, mean: float, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; queries are taken in blocks with about ``TERMS`` terms."""
    asked = stored(_asked(queries))
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS))
    parts = []
    for at in range(blocks):
        some = [(r["query_id"], list(r["terms"])) for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at).collect()]
        if some:
            parts.append(stored(_search(hits_of, total, mean, some, k)))
    met = functools.reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def batch_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``batch_search_by_postings`` over rows without an index: a pass over the texts for each block of queries, nothing of them is shuffled or written."""
    sizes = docs.where("id is not null").select(document_size().alias("size")).agg(F.count("*").alias("total"), F.avg("size").alias("mean")).first()
    return _batches(functools.partial(text_hits, docs), sizes["total"], sizes["mean"] or 1.0, queries, k)


def batch_search_by_postings(index: Postings, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best rows of each query (query_id, terms array): query_id, rank, id, score.

    Terms of fewer than three characters are passed over; a document counts when it holds all others. Each block of queries
    is one pass over the wanted part of the index.
    """
    return _batches(functools.partial(term_hits, index), index.total, index.mean, queries, k)
