"""Vectors of a table as rows that take part in searches, equal ones together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (array<double>): rows without a null id, null, non-finite or missing components or zero vectors.

    Where lengths differ only vectors of the most common length take part (the shorter one at a tie).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    length = sound.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return sound.where(F.size("vec") == (length["d"] if length else 0))


def with_smallest_ids(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``key`` and ids: the ``most`` smallest ids of equal keys, in order.

    For k nearest among others than itself k + 1 ids of equal vectors are enough, as ties go to smaller ids.
    The rank filter cuts each key before it is shuffled.
    """
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("rank") <= most)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
