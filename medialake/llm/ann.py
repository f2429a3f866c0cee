"""Approximate nearest neighbours with a navigable small-world graph per shard (operator 6).

Equal vectors become one (with the smallest ids that any answer can need). They are dealt at random
into shards of a bounded number of vectors; each shard becomes one hierarchical graph whose layers are
flat arrays of neighbour numbers, stored as a table in the shared folder. For search, blocks of queries
are sent to every shard, walk its graph together (a beam per query over numpy arrays), and give the shard's
best; the results of the shards are merged by rank. Vectors get one more component that makes the
largest inner product the smallest distance, so that graph edges mean the same as the search.

A node has edges of three kinds. Its nearest of the layer, found in blocks of rows and chosen by the
relative-neighbour rule, lead through its neighbourhood; the nearest of random samples of falling size take part in
that rule and lead out of a cluster that is larger than the list of nearest; and those of largest inner product
lead to the long vectors that answer queries where lengths differ. Edges of the first two kinds are made mutual.
A beam, and not one node, goes down from layer to layer, so a query that an upper layer leads astray has other ways.

Edges cost the pairs of a shard and searches cost queries times shards, so the size of a shard grows with the root
of the number of queries, up to what a task's memory holds.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows with null ids; ties go to smaller ids; every row is a candidate
of its own, also another row of the query's id; query rows that agree in id and vector are one query, and those
that agree in id only are two, each with results of its own under that id; an empty table, or one without queries,
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.llm.vectors import usable, with_smallest_ids
from medialake.plans.shared import stored

#: Fewest and most vectors of a shard; how many pairs of a shard cost as much as one query's walk.
LEAST_SHARD = 8192
MOST_SHARD = 131_072
PAIRS_A_WALK = 50_000
#: Queries of a block, degree of upper layers (twice it at the bottom), candidates of each kind, beam, nodes of a beam that a step expands.
BLOCK = 2048
DEGREE = 16
CANDIDATES = 64
ALIKE = 16
SAMPLED = 8
BEAM = 96
STEP = 4
#: Inner products that are held at a time.
PRODUCTS = 1 << 22
#: Parts of the largest sample that the samples for far edges are.
SCALES = (1, 8, 64)

INDEX = "shard int, vectors binary, ids binary, counts binary, layers array<struct<members:binary,neighbours:binary>>, dims int"
HITS = "query long, id long, vec_id long, score double"


def _best_columns(values: np.ndarray, count: int) -> np.ndarray:
    """Columns of the ``count`` smallest values of each row, smallest first."""
    best = np.argpartition(values, count - 1, axis=1)[:, :count]
    return np.take_along_axis(best, np.argsort(np.take_along_axis(values, best, axis=1), axis=1), axis=1)


def _candidates(points: np.ndarray, near: int, alike: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """For each point of a layer the numbers of (its nearest, and the nearest of random samples; those of largest inner product)."""
    n = len(points)
    norms = (points**2).sum(axis=1)
    size = max(1, int(4 * np.sqrt(n)))
    samples = [draw.permutation(n)[: max(1, size // part)] for part in SCALES]
    close, most = [], []
    block = max(16, PRODUCTS // n)
    for at in range(0, n, block):
        some = points[at : at + block]
        rows = np.arange(len(some))
        product = some[:, :-1] @ points[:, :-1].T
        away = norms[None, :] - 2 * (product + np.outer(some[:, -1], points[:, -1]))
        away[rows, at + rows] = np.inf
        product[rows, at + rows] = -np.inf
        far = [sample[_best_columns(away[:, sample], min(SAMPLED, len(sample)))] for sample in samples]
        close.append(np.concatenate([_best_columns(away, near), *far], axis=1))
        most.append(_best_columns(-product, alike))
    return np.concatenate(close), np.concatenate(most)


def _chosen(points: np.ndarray, options: np.ndarray, degree: int) -> np.ndarray:
    """(n, degree) numbers: options that are nearer to their point than to any option chosen before, then the nearest of the others."""
    n = len(points)
    chosen = np.full((n, degree), -1, np.int32)
    for at in range(0, n, 512):
        own = np.arange(at, min(n, at + 512))
        option = np.sort(options[own], axis=1)
        void = option == own[:, None]
        void[:, 1:] |= option[:, 1:] == option[:, :-1]
        found = points[option] - points[own][:, None, :]
        square = (found**2).sum(axis=2)
        order = np.argsort(np.where(void, np.inf, square), axis=1)
        option, square, void = (np.take_along_axis(x, order, axis=1) for x in (option, square, void))
        found = np.take_along_axis(found, order[:, :, None], axis=1)
        between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(found, found.transpose(0, 2, 1))
        taken = np.zeros(option.shape, bool)
        closest = np.full(option.shape, np.inf, points.dtype)
        for k in range(option.shape[1]):
            keep = ~void[:, k] & (square[:, k] < closest[:, k]) & (taken.sum(axis=1) < degree)
            taken[keep, k] = True
            closest[keep] = np.minimum(closest[keep], between[keep, k])
        order = np.argsort(np.where(void, 2, ~taken), axis=1, kind="stable")[:, :degree]
        kept = np.where(np.take_along_axis(void, order, axis=1), -1, np.take_along_axis(option, order, axis=1))
        chosen[own, : kept.shape[1]] = kept
    return chosen


def _backward(points: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(n, degree) numbers of the nearest that chose a node and were not chosen by it."""
    n, degree = chosen.shape
    own = np.repeat(np.arange(n), degree)
    to = chosen.ravel()
    own, to = own[to >= 0], to[to >= 0]
    missing = ~np.isin(to * np.int64(n) + own, own * np.int64(n) + to)
    node, other = to[missing], own[missing]
    away = ((points[node] - points[other]) ** 2).sum(axis=1)
    order = np.lexsort((away, node))
    node, other = node[order], other[order]
    place = np.arange(len(node)) - np.searchsorted(node, node)
    wide = np.full((n, degree), -1, np.int32)
    fits = place < degree
    wide[node[fits], place[fits]] = other[fits]
    return wide


def _edges(points: np.ndarray, degree: int, candidates: int, draw: np.random.Generator) -> np.ndarray:
    """Neighbour numbers of one layer, a row for each point, -1 where there are fewer."""
    n = len(points)
    if n == 1:
        return np.full((1, 1), -1, np.int32)
    options, alike = _candidates(points, min(candidates, n - 1), min(ALIKE, n - 1), draw)
    chosen = _chosen(points, options, degree)
    both = np.concatenate([chosen, _backward(points, chosen)], axis=1)
    known = (alike[:, :, None] == both[:, None, :]).any(axis=2)
    return np.concatenate([both, np.where(known, -1, alike)], axis=1).astype(np.int32)


def build_graph(points: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top: (members as numbers of points, neighbours as numbers of members). The last component is the added one."""
    draw = np.random.default_rng(seed)
    levels = (-np.log(draw.random(len(points))) / np.log(degree)).astype(int)
    levels[0] = max(levels.max(), 0)  # one entry point at the top
    layers = []
    for level in range(levels.max(), -1, -1):
        members = np.flatnonzero(levels >= level).astype(np.int32)
        layers.append((members, _edges(points[members], degree if level else 2 * degree, candidates, draw)))
    return layers


def walk(points: np.ndarray, members: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, step: int = STEP) -> np.ndarray:
    """The beam of each query at the end of one layer: member numbers, best first, -1 for none.

    A step expands the ``step`` best nodes of each beam that were not expanded yet.
    """
    q, n = len(queries), len(members)
    local = points[members]
    # Number n stands for none: it is always seen and has no other neighbours.
    around = np.concatenate([np.where(neighbours >= 0, neighbours, n), np.full((1, neighbours.shape[1]), n)]).astype(np.int32)
    held = np.full((q, beam), n, np.int64)
    held[:, : entries.shape[1]] = np.where(entries >= 0, entries, n)
    fresh = held < n
    score = np.full((q, beam), -np.inf, points.dtype)
    rows, columns = np.nonzero(fresh)
    score[rows, columns] = np.einsum("kd,kd->k", local[held[rows, columns]], queries[rows])
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    seen[rows, held[rows, columns]] = True
    active = np.arange(q)
    while True:
        options = np.where(fresh[active], score[active], -np.inf)
        alive = options.max(axis=1) > -np.inf
        active, options = active[alive], options[alive]
        if not len(active):
            break
        best = np.argpartition(-options, min(step, beam) - 1, axis=1)[:, : min(step, beam)]
        usable_ = np.take_along_axis(options, best, axis=1) > -np.inf
        fresh[active[:, None], best] = False
        met = around[np.where(usable_, held[active[:, None], best], n)].reshape(len(active), -1)
        at, column = np.nonzero(~seen[active[:, None], met])
        # Several expanded nodes may lead to the same one.
        at, number = np.divmod(np.unique(at * np.int64(n + 1) + met[at, column]), n + 1)
        if not len(at):
            continue
        seen[active[at], number] = True
        count = np.bincount(at, minlength=len(active))
        place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        more = np.full((len(active), count.max()), n, np.int64)
        gain = np.full(more.shape, -np.inf, points.dtype)
        more[at, place] = number
        gain[at, place] = np.einsum("kd,kd->k", local[number], queries[active[at]])
        all_score = np.concatenate([score[active], gain], axis=1)
        keep = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        held[active] = np.take_along_axis(np.concatenate([held[active], more], axis=1), keep, axis=1)
        score[active] = np.take_along_axis(all_score, keep, axis=1)
        fresh[active] = np.take_along_axis(np.concatenate([fresh[active], more < n], axis=1), keep, axis=1)
    held = np.take_along_axis(held, np.argsort(-score, axis=1, kind="stable"), axis=1)
    return np.where(held < n, held, -1)


def search_graph(points: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int) -> np.ndarray:
    """Numbers of points found for each query (n queries, beam), -1 for none."""
    at = np.zeros((len(queries), 1), np.int64)  # point 0 is in every layer
    for members, neighbours in layers:
        entries = np.where(at >= 0, np.searchsorted(members, at), -1)
        held = walk(points, members, neighbours, queries, entries, max(min(beam, len(members)), entries.shape[1]))
        at = np.where(held >= 0, members[np.maximum(held, 0)], -1)
    return at


def shard_size(queries: int) -> int:
    """Vectors of a shard at which edges and ``queries`` searches cost about the same, within what a task holds."""
    return int(min(MOST_SHARD, max(LEAST_SHARD, (PAIRS_A_WALK * queries) ** 0.5)))


def build_index(vectors: DataFrame, k: int, shard: int = LEAST_SHARD, degree: int = DEGREE, candidates: int = CANDIDATES) -> DataFrame:
    """A row for each shard: its vectors, their ids and the layers of its graph as flat arrays."""
    distinct = stored(with_smallest_ids(vectors, "vec", k + 1))
    shards = max(1, -(-distinct.count() // shard))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("first").reset_index(drop=True)
        exact = np.stack(part["vec"].to_numpy()).astype(np.float64)
        scaled = exact / np.abs(exact).max()
        square = (scaled**2).sum(axis=1)
        points = np.concatenate([scaled, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)
        layers = [{"members": m.tobytes(), "neighbours": e.tobytes()} for m, e in build_graph(points, degree, candidates)]
        ids = np.concatenate(part["ids"].to_list()).astype(np.int64)
        counts = np.fromiter(map(len, part["ids"]), np.int64, len(part))
        return pd.DataFrame({"shard": [key[0]], "vectors": [exact.tobytes()], "ids": [ids.tobytes()], "counts": [counts.tobytes()], "layers": [layers], "dims": [exact.shape[1]]})

    dealt = distinct.select("vec", "ids", F.col("ids")[0].alias("first")).withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInPandas(build, INDEX))


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """query, id, rank, vec_id, score of the k best of every query (query, id, vec) over all shards.

    Blocks of queries are sent to the shards; each row of the join is one block and one shard.
    """
    blocks = max(1, -(-queries.count() // block))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("query", "id", "vec")).alias("queries"))
    shards = index.agg(F.max("shard")).first()[0]
    sent = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards or 0))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                exact = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])
                ids = np.split(np.frombuffer(row["ids"], np.int64), np.cumsum(np.frombuffer(row["counts"], np.int64))[:-1])
                layers = []
                for layer in row["layers"]:
                    members = np.frombuffer(layer["members"], np.int32)
                    layers.append((members, np.frombuffer(layer["neighbours"], np.int32).reshape(len(members), -1)))
                points = (exact / np.abs(exact).max()).astype(np.float32)
                hits = []
                for at in range(0, len(row["queries"]), 256):
                    some = row["queries"][at : at + 256]
                    asked = np.stack([q["vec"] for q in some]).astype(np.float64)
                    scaled = (asked / np.abs(asked).max(axis=1, keepdims=True)).astype(np.float32)
                    hits += _best(some, asked, exact, ids, search_graph(points, layers, scaled, max(beam, k + 1)), k)
                yield pd.DataFrame(hits, columns=["query", "id", "vec_id", "score"])

    hits = sent.join(index, "shard").select("queries", *[c for c in index.columns if c != "shard"]).mapInPandas(search, HITS)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(asked: list, vectors: np.ndarray, exact: np.ndarray, ids: list[np.ndarray], found: np.ndarray, k: int) -> list[tuple[int, int, int, float]]:
    out: list[tuple[int, int, int, float]] = []
    for q, vector, points in zip(asked, vectors, found):
        points = points[points >= 0]
        # Summed in order in double precision, as the exact score.
        scores = np.cumsum(exact[points] * vector, axis=1)[:, -1]
        hits = []
        for score, point in zip(scores.tolist(), points.tolist()):
            others = ids[point].tolist()
            if q["id"] in others and np.array_equal(exact[point], vector):
                others.remove(q["id"])  # the query's own row, and no other row of its id
            hits += [(-score, i) for i in others]
        out += [(q["query"], q["id"], i, -score) for score, i in sorted(hits)[:k]]
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every vector whose id is divisible by ``every``, by largest inner product."""
    rows = stored(usable(vectors, id_col, vector_col))
    queries = stored(rows.where(F.col("id") % every == 0).distinct().withColumn("query", F.monotonically_increasing_id()))
    found = search_index(build_index(rows, k, shard or shard_size(queries.count())), queries, k, beam, block)
    return found.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
