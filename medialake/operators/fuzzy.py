"""Fuzzy matches of queries by an index of cells with upper bounds, and candidates of words by trigrams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.functions.fuzzy_bounds import Cell, Query, features, sizes
from medialake.plans.shared import stored

CUTOFF = 75.0
MOST = 50
#: Items of a cell; queries and their characters that go to the tasks at a time.
CELL = 256
QUERIES = 2048
QUERY_CHARS = 1 << 20


def grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams, lower case; the whole text if it is shorter."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(low) - (n - 1))), lambda i: F.substring(low, i, F.lit(n))))


def fuzzy_text(items: DataFrame) -> DataFrame:
    """id and the text that fuzzy queries are compared with: the file's stem in words, and the title."""
    return items.select("id", F.trim(F.concat_ws(" ", F.translate("stem", "-_", "  "), "title")).alias("choice"))


def build_fuzzy_index(items: DataFrame) -> DataFrame:
    """Cells of ``CELL`` items of similar length and characters: ids, texts, lengths and counts that bound scores.

    Items are dealt by ranges of (length, signature), so that a cell holds lengths next to each other and a
    query reads only the cells whose lengths it may match. A row is a cell; write it once with ``stored`` or
    as a table of its own to serve many query logs.
    """
    choices = fuzzy_text(items).select(F.col("id").cast("long").alias("id"), F.coalesce("choice", F.lit("")).alias("choice"))
    order = [F.char_length("choice"), F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("choice"), ""))), ""), F.col("id")]
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = choices.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_cells, _INDEX)
    # Cells of long texts cost most: each file gets some of every length.
    return cells.repartition(parts)


_INDEX = "ids array<long>, texts array<string>, lengths binary, counts binary, shortest int, longest int"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("lengths", pa.binary()), ("counts", pa.binary()), ("shortest", pa.int32()), ("longest", pa.int32())])
    for batch in batches:
        for begin in range(0, batch.num_rows, CELL):
            part = batch.slice(begin, CELL)
            texts = part.column("choice").to_pylist()
            lengths = sizes(texts)
            row = {"ids": part.column("id").to_pylist(), "texts": texts, "lengths": lengths.tobytes(), "counts": features(texts).tobytes(), "shortest": lengths[0].min(), "longest": lengths[0].max()}
            yield pa.RecordBatch.from_pylist([row], schema)


def _search(cells: DataFrame, asked: list[tuple[int, str]], cutoff: float, k: int) -> DataFrame:
    """(query_id, id, score) of the best k of each partition, and a row (query_id, null, scores computed) each."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(q, Query(text)) for q, text in asked]
        held: list[list] = [[] for _ in queries]
        scored = [0] * len(queries)
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                cell = Cell(np.array(row["ids"], np.int64), row["texts"], np.frombuffer(row["counts"], np.uint8).reshape(-1, n), np.frombuffer(row["lengths"], np.int64).reshape(3, n))
                for at, (_, query) in enumerate(queries):
                    if reaches(len(query.text), row["shortest"], row["longest"], held[at][0][0] if len(held[at]) == k else cutoff):
                        scored[at] += cell.best(query, cutoff, k, held[at])
        rows = [(q, -i, score) for (q, _), best in zip(queries, held) for score, i in best] + [(q, None, float(n)) for (q, _), n in zip(queries, scored) if n]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    return cells.mapInArrow(per_partition, "query_id long, id long, score double")


def reaches(n: int, shortest: int, longest: int, least: float) -> bool:
    """Whether any text of ``shortest`` to ``longest`` characters may score ``least`` with a query of n characters."""
    if least > 60 and (shortest > 8 * n or 0 < 8 * longest < n):
        return False  # beyond eight times the length, parts weigh 0.6
    return least <= 0 or n > 0 and longest > 0


def _met(cells: DataFrame, queries: DataFrame, cutoff: float, k: int) -> DataFrame:
    """``_search`` for all queries, in blocks that fit into the closure of a task."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("q", F.lit("")).alias("q"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("q")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // QUERIES), -(-size["chars"] // QUERY_CHARS))
    block = F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks))
    parts = []
    for at in range(blocks):
        some = [(r["query_id"], r["q"]) for r in asked.where(block == at).collect()]
        found = _search(cells, some, cutoff, k)
        parts.append(stored(found) if blocks > 1 else found)
    return functools.reduce(DataFrame.unionByName, parts)


def search_fuzzy_index(cells: DataFrame, queries: DataFrame, cutoff: float = CUTOFF, k: int = MOST) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` best items of each query (query_id, q) from ``cutoff`` on, ties to smaller ids.

    The rows are those of comparing all pairs. Each task reads its cells once for a block of ``QUERIES``
    queries and holds the k best of each: a cell is passed over if its lengths rule it out, its texts are scored in
    the order of their upper bounds, and the query is done with the cell when the next bound is below the kth
    score held. Nothing of the index is shuffled, only k rows a query and task. Null texts are empty and match nothing.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    met = _met(cells, queries, cutoff, k).where("id is not null")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def scores_computed(cells: DataFrame, queries: DataFrame, cutoff: float = CUTOFF, k: int = MOST) -> DataFrame:
    """(query_id, scored): of how many items a query's score was computed; for the rest a bound was enough."""
    return _met(cells, queries, cutoff, k).where("id is null").groupBy("query_id").agg(F.sum("score").cast("long").alias("scored"))


def fuzzy_match(items: DataFrame, queries: DataFrame, cutoff: float = CUTOFF, k: int = MOST) -> DataFrame:
    """``search_fuzzy_index`` over an index that is built for these queries only."""
    cells = build_fuzzy_index(items)
    return search_fuzzy_index(stored(cells), queries, cutoff, k)


def fuzzy_candidates(left: DataFrame, right: DataFrame, shared: int = 2, distance: int = 2) -> DataFrame:
    """(l, r, shared, distance): pairs of words with at least ``shared`` trigrams in common and at most ``distance`` edits.

    An edit takes at most three distinct trigrams away, so a word with g of them shares at least g - 3 * ``distance``
    with its partner; of two such words the rarest trigrams, all but that number less one, have one in common. Words
    meet by these only and are verified where they meet.
    """
    l, r = (side.select("word").where("word is not null").distinct().withColumn("grams", grams(F.col("word"))) for side in (left, right))
    often = l.unionByName(r).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))

    def rare(words: DataFrame) -> DataFrame:
        ranked = words.select("word", "grams", F.explode("grams").alias("gram")).join(often, "gram")
        ordered = ranked.groupBy("word").agg(F.first("grams").alias("grams"), F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("o"))
        least = F.greatest(F.lit(shared), F.size("o") - 3 * distance)
        return ordered.select("word", "grams", F.explode(F.slice("o", 1, F.greatest(F.lit(0), F.size("o") - least + 1))["gram"]).alias("gram"))

    a = rare(l).select(F.col("word").alias("l"), F.col("grams").alias("l_grams"), F.col("gram").alias("l_gram"))
    b = rare(r).select(F.col("word").alias("r"), F.col("grams").alias("r_grams"), F.col("gram").alias("r_gram"))
    near = (F.abs(F.char_length("l") - F.char_length("r")) <= distance) & (F.levenshtein("l", "r", distance) >= 0)
    met = a.join(b, (F.col("l_gram") == F.col("r_gram")) & near)
    both = met.select("l", "r", F.size(F.array_intersect("l_grams", "r_grams")).cast("long").alias("shared")).distinct()
    return both.where(F.col("shared") >= shared).withColumn("distance", F.levenshtein("l", "r", distance))
