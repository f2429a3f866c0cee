"""Line deduplication with DataFrame functions only (operator 2).

Lines are normalised, exploded with their places and hashed to 128 bits; a hash that stands in at
least ``min_docs`` documents loses its lines everywhere but in the largest doc_id. Hashes, ids and places are
shuffled; the list of a document's places to drop comes back to it and the runs of lines between them
are joined again by position, in time linear in the lines. Only texts that lose lines are moved.

Defined results: null and empty texts are one empty line; rows that share a doc_id are one document
for counting and each keeps its own lines; a row with a null doc_id is not counted and loses every
line that is dropped anywhere; an empty table gives an empty result; other columns are kept as they
are, and a column named like a new one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.membership import packed_by_ids
from medialake.plans.shared import stored

MIN_CHARS = 40
MIN_DOCS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
#: Parts into which the documents of one line are dealt in the join.
SALTS = 8


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, nothing else changes."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column, min_chars: int) -> Column:
    """For each line its key, null for a short one."""
    keys = F.transform(_lines(text), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= min_chars, ascii_lower(key)))


def _without(text: Column, drops: Column) -> Column:
    """The text without the lines at the places ``drops`` (sorted), run of kept lines by run of kept lines."""

    def runs(lines: Column) -> Column:
        first = lambda k: F.coalesce(F.get(drops, k - 1) + 1, F.lit(0))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), lambda k: F.slice(lines, first(k) + 1, F.coalesce(F.get(drops, k), F.size(lines)) - first(k))))

    # The lines are bound by a one-element array, so that they are split once and not once a run.
    return F.array_join(F.get(F.transform(F.array(_lines(text)), runs), F.lit(0)), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and n_lines (before) and n_dropped."""
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("id"), _keys(F.col("text"), min_chars).alias("keys"))
    found = keyed.select("doc", "id", F.posexplode("keys").alias("place", "key")).where("key is not null")
    places = stored(found.select("doc", "id", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    common = places.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs)
    salted = common.select("h1", "h2", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = places.withColumn("salt", F.pmod(F.xxhash64("doc", "id"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    # A row is known by its id and text: rows that agree in both lose the same lines.
    drops = stored(gone.groupBy("doc", "id").agg(F.sort_array(F.collect_set("place")).alias("drops")))
    some, others = packed_by_ids(docs, F.xxhash64(docs["text"]), drops.select("id"))
    lists = drops.select(F.col("doc").alias("of"), "id", "drops")
    met = some.join(lists, (some["id"] == lists["id"]) & some["own.doc_id"].eqNullSafe(lists["of"]), "left").select("own", "drops")
    text = F.col("own.text")
    n_lines = F.size(_lines(text)).cast("long").alias("n_lines")
    kept = F.when(F.col("drops").isNull(), F.coalesce(text, F.lit(""))).otherwise(_without(text, F.col("drops")))
    shorter = met.select("own", n_lines, kept.alias("kept_text"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
    whole = others.select("own", n_lines, F.coalesce(text, F.lit("")).alias("kept_text"), F.lit(0).cast("long").alias("n_dropped"))
    kinds = [F.col("own")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return shorter.unionByName(whole).select(*kinds, F.col("kept_text").alias("text"), "n_lines", "n_dropped")
