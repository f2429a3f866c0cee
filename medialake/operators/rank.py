"""Ranking of matches by weighted BM25 over trigrams, for one query and for a log of queries."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.operators.search import FIELDS, match_all_terms
from medialake.plans.shared import stored

#: Weights of the fields, and the formula's constants.
WEIGHTS = {"name": 4.0, "title": 5.0, "description": 2.0, "ocr_text": 2.0, "tags": 4.0, "topics": 2.0, "category": 1.0}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
GRAM = 3
#: Terms that one pass over the rows looks for.
TERMS = 50_000


def occurrences(column: str, term: str) -> Column:
    """How often a term stands in a text, overlapping ones included, whatever the case."""
    return F.regexp_count(F.lower(column), F.lit(f"(?={re.escape(term.lower())})"))


def document_size(fields: tuple[str, ...] = FIELDS) -> Column:
    size = F.lit(0)
    for f in fields:
        size = size + F.greatest(F.lit(0), F.char_length(f) - (GRAM - 1))
    return size


def inverse_frequency(total: Column, having: Column) -> Column:
    value = F.log((total - having + 0.5) / (having + 0.5))
    return F.when(value > 0, value).otherwise(LEAST_IDF)


def term_part(idf: Column, frequency: Column, size: Column, mean: Column) -> Column:
    return idf * frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * size / mean))


def bm25_rank(docs: DataFrame, terms: list[str] | tuple[str, ...], weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score) of the rows that hold all terms; lower is better. Statistics cover all of ``docs``."""
    weights = weights or WEIGHTS
    counted = docs.select("id", *FIELDS, document_size().alias("size"))
    holding = [F.count_if(F.greatest(*[F.contains(F.lower(f), F.lit(t.lower())) for f in FIELDS])).alias(f"n{k}") for k, t in enumerate(terms)]
    stats = counted.agg(F.count("*").alias("total"), F.avg("size").alias("mean"), *holding).first()
    score = F.lit(0.0)
    for k, term in enumerate(terms):
        frequency = F.lit(0.0)
        for f, weight in weights.items():
            frequency = frequency + weight * occurrences(f, term)
        score = score + term_part(inverse_frequency(F.lit(stats["total"]), F.lit(stats[f"n{k}"])), frequency, F.col("size"), F.lit(stats["mean"]))
    return match_all_terms(counted, terms).select("id", (-score).alias("score"))


def term_frequencies(docs: DataFrame, terms: DataFrame, block: int = TERMS) -> DataFrame:
    """(term, id, size, frequency): the weighted places of every term in every row that holds it, overlapping ones included.

    Terms (lower case) are taken in blocks of about ``block``, each one pass over the rows with one automaton.
    """
    weights = list(WEIGHTS.values())
    rows = docs.select("id", document_size().cast("long").alias("size"), *[F.lower(f).alias(f) for f in WEIGHTS])
    blocks = max(1, -(-terms.count() // block))

    def passed(words: list[str]) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for word in words:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                found: dict[str, list] = {"term": [], "id": [], "size": [], "frequency": []}
                for row, size, *texts in zip(*(column.to_pylist() for column in batch.columns)):
                    met: Counter = Counter()
                    for text, weight in zip(texts, weights):
                        for _, word in automaton.iter(text or ""):
                            met[word] += weight
                    for word, frequency in met.items():
                        for name, value in zip(found, (word, row, size, frequency)):
                            found[name].append(value)
                yield pa.RecordBatch.from_pydict(found, _FREQUENCIES)

        return rows.mapInArrow(find, "term string, id long, size long, frequency double")

    parts = []
    for k in range(blocks):
        words = [r["term"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect()]
        parts += [passed(words)] if words else []
    return functools.reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], "term string, id long, size long, frequency double")


_FREQUENCIES = pa.schema([("term", pa.string()), ("id", pa.int64()), ("size", pa.int64()), ("frequency", pa.float64())])


def batch_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best rows of each query (query_id, terms array): query_id, rank, id, score.

    A document counts for a query when all its terms are found; the distinct terms of all queries are found in one pass.
    """
    asked = stored(queries.select("query_id", F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(t)))).alias("term")).where(F.char_length("term") >= GRAM))
    hits = stored(term_frequencies(docs, asked.select("term").distinct()))
    having = hits.groupBy("term").agg(F.count("*").alias("having"))
    stats = docs.select(document_size().alias("size")).agg(F.count("*").alias("total"), F.avg("size").alias("mean")).first()
    parts = hits.join(having, "term").select("term", "id", term_part(inverse_frequency(F.lit(stats["total"]), F.col("having")), F.col("frequency"), F.col("size"), F.lit(stats["mean"] or 1.0)).alias("part"))
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    scored = asked.join(parts, "term").groupBy("query_id", "id").agg((-F.sum("part")).alias("score"), F.count("*").alias("met")).join(needed, "query_id").where("met = needed")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
