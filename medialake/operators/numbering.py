"""Consecutive numbers for rows of a table in an order, without one task holding them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.plans.shared import stored


def number_rows(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """``df`` with 0, 1, 2 ... in ``name``, by range partitions whose sizes are summed up.

    Only one count per partition meets in a window; rows are numbered within their partition.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_in", F.row_number().over(within) - 1).join(sizes, "_part").withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_part", "_in", "_start")
