"""Exact top-k search of binary codes by incremental multi-index hashing (operator 10).

A vector's code is the signs of its components. Equal codes are one (with the smallest ids that an
answer can need). A code is cut into segments of about log2(number of codes) - 2 bits and stands once per
segment in the index. For a query all segment values within a radius are looked up, the radius growing
by one bit, segment by segment where that is many values, and only the new values being joined, with codes no farther than the kth held so far. When
the first a of m segments have been looked up to radius r and the others to r - 1, every code within
m * r + a - 1 bits has been met, so a query whose kth verified distance is within that is
done; ties at that distance are then complete too. Rounds join queries that are not done with the
index by equality; nothing is compared with all rows.

Defined results: rows with null ids or vectors that are null, zero, of another length than most or hold
null or non-finite components take no part (more than 64 components: an error); rows of one id are one item, of
which the smallest code (as a signed number) counts, so repeated rows change nothing; ties go to smaller
ids; with fewer than k candidates all are returned; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.llm.vectors import usable, with_smallest_ids
from medialake.plans.shared import shared_dir, stored

K = 10
EVERY = 100
#: Radius up to which all segments are looked up in one round; beyond it each segment is a round.
TOGETHER = 2


def sign_code(vec: Column) -> Column:
    """Bit i is 1 where component i is not negative."""
    bits = F.zip_with(vec, F.sequence(F.lit(0), F.size(vec) - 1), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _segments(codes: int, dims: int) -> list[tuple[int, int]]:
    """(first bit, width) of segments of about log2(codes) - 2 bits each, between 4 and 16."""
    wanted = min(16, max(4, round(math.log2(max(2, codes))) - 2))
    parts = max(1, min(dims, math.ceil(dims / wanted)))
    edges = [dims * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rounds(segments: int, widest: int) -> list[tuple[int, list[int], int]]:
    """(radius, segments to look up, bits within which every code has then been met)."""
    rounds = [(r, list(range(segments)), segments * (r + 1) - 1) for r in range(min(TOGETHER, widest) + 1)]
    return rounds + [(r, [k], segments * r + k) for r in range(TOGETHER + 1, widest + 1) for k in range(segments)]


def _values(code: Column, segments: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("segment"), F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("value")) for k, (at, width) in enumerate(segments)])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, distance: the k codes nearest to each query's, other than itself."""
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = usable(vectors, id_col, vector_col)
    signed = rows.select("id", F.size("vec").alias("dims"), sign_code(F.col("vec")).alias("code"))
    coded = stored(signed.groupBy("id").agg(F.first("dims").alias("dims"), F.min("code").alias("code")))
    codes = stored(with_smallest_ids(coded, "code", k + 1))
    size, dims = codes.count(), coded.agg(F.max("dims")).first()[0] or 1
    if dims > 64:
        raise ValueError(f"codes of {dims} bits; at most 64 are supported")
    segments = _segments(size, dims)
    widest = max(width for _, width in segments)
    index = stored(codes.select("code", F.explode(_values(F.col("code"), segments)).alias("s")).select("s.segment", "s.value", "code"))
    masks = stored(spark.range(1 << widest).select(F.col("id").cast("int").alias("mask")).withColumn("ones", F.bit_count("mask")))
    widths = F.array(*[F.lit(width) for _, width in segments])
    queries = coded.where(F.col("id") % every == 0).select("id", "code").distinct()
    asked = stored(queries.select(F.col("code").alias("query")).distinct())
    probes = stored(asked.select("query", F.explode(_values(F.col("query"), segments)).alias("s")).select("query", "s.segment", "s.value", F.element_at(widths, F.col("s.segment") + 1).alias("width")))
    need = F.least(F.lit(k + 1), F.size("ids"))
    best = None
    done = None
    active = asked.withColumn("bound", F.lit(64))
    rounds = _rounds(len(segments), widest)
    for radius, part, covered in rounds:
        flips = masks.where(F.col("ones") == radius).select("mask")
        looked_up = probes.where(F.col("segment").isin(part)).join(active, "query").join(flips, F.col("mask") < F.call_function("shiftleft", F.lit(1), F.col("width")))
        probed = looked_up.select("query", "bound", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        verified = probed.join(index, ["segment", "value"]).where(distance <= F.col("bound")).select("query", "code", distance.alias("distance")).distinct()
        held = verified if best is None else best.join(active.select("query"), "query", "left_semi").unionByName(verified).distinct()
        # k + 1 rows by distance and smallest id hold the answer of every query with this code.
        ranked = held.join(codes.select("code", "ids"), "code").withColumn("least", F.col("ids")[0])
        order = Window.partitionBy("query").orderBy("distance", "least")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).withColumn("enough", need)
        best = stored(ranked.select("query", "code", "distance", "enough"))
        sums = best.groupBy("query").agg(
            F.sum(F.when(F.col("distance") <= covered, F.col("enough")).otherwise(0)).alias("sure"), F.when(F.sum("enough") >= k + 1, F.max("distance")).otherwise(64).alias("bound")
        )
        ready = sums.where((F.col("sure") >= k + 1) | F.lit(covered >= dims or (radius, part, covered) == rounds[-1])).select("query")
        finished = best.join(ready, "query", "left_semi")
        done = finished if done is None else done.unionByName(finished)
        best = best.select("query", "code", "distance")
        # Only codes as near as the farthest one held can still come in.
        active = stored(active.select("query").join(ready, "query", "left_anti").join(sums.select("query", "bound"), "query", "left").select("query", F.coalesce("bound", F.lit(64)).alias("bound")))
        if active.isEmpty():
            break
    hits = queries.withColumnRenamed("code", "query").join(done.select("query", "code", "distance"), "query").join(codes, "code")
    each = hits.select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "distance").where("query_id <> vec_id")
    by_distance = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return each.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("distance").cast("long").alias("distance"))
