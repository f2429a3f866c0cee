"""Rows of a wide table by a list of ids, without shuffling the rows that are not meant.

A Bloom filter of a fixed number of bits is built by a grouped aggregation and broadcast as a table of
at most ``BITS`` / 64 words, so its size has a bound that does not depend on the data. Rows that it rules
out never move; the others meet the exact ids in an ordinary join. When ids are so many that the filter
lets everything pass, the result is the same and every row is shuffled as without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def _slot(ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(BITS))


def _words(ids: DataFrame) -> DataFrame:
    """(word, bits) of the filter."""
    slots = ids.select(_slot(F.col(ids.columns[0])).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    return slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def packed_by_ids(rows: DataFrame, ids_of: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ``ids``, rows whose id surely is not), each as ``id`` and the struct ``own``; null ids never are."""
    packed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("own"), ids_of.cast("long").alias("id")).withColumn("word", F.shiftright(_slot(F.col("id")), 6))
    met = packed.join(F.broadcast(_words(ids)), "word", "left")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (_slot(F.col("id")) % 64).cast("int"))
    maybe = F.col("id").isNotNull() & F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    return met.where(maybe).select("id", "own"), met.where(~maybe).select("id", "own")


def rows_of_ids(rows: DataFrame, ids_of: Column, ids: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose id is among ``ids``."""
    found = packed_by_ids(rows, ids_of, ids)[0].join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi")
    return found.select("own.*")
