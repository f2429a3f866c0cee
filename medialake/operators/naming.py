"""File names that do not collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_collisions(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``rows`` (id, slug, arrival) with a stem each: the slug, or with 6 or 12 characters of the id.

    A slug is free for the first arrival if no other id holds the stem (``existing``: stem, id). The next
    ones take the short suffix, and where that is taken too, the long one.
    """
    held = existing.select(F.col("stem").alias("slug"), F.col("id").alias("holder"))
    first = Window.partitionBy("slug").orderBy("arrival", "id")
    ranked = rows.join(held.groupBy("slug").agg(F.min("holder").alias("holder")), "slug", "left").withColumn("nth", F.row_number().over(Window.partitionBy("slug").orderBy((F.col("holder").eqNullSafe(F.col("id"))).desc(), "arrival", "id")))
    free = (F.col("nth") == 1) & (F.col("holder").isNull() | (F.col("holder") == F.col("id")))
    short = F.concat_ws("-", "slug", F.substring("id", 1, 6))
    asked = ranked.withColumn("stem", F.when(free, F.col("slug")).otherwise(short)).withColumn("free", free)
    taken = held.select(F.col("slug").alias("stem"), F.lit(True).alias("taken")).distinct()
    again = Window.partitionBy("stem").orderBy(F.desc("free"), "arrival", "id")
    second = asked.join(taken, "stem", "left").withColumn("nth", F.row_number().over(again))
    long_name = F.concat_ws("-", "slug", F.substring("id", 1, 12))
    clash = ~F.col("free") & (F.coalesce("taken", F.lit(False)) | (F.col("nth") > 1))
    return second.select("id", "slug", F.when(clash, long_name).otherwise(F.col("stem")).alias("stem"))


def unique_names(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``rows`` (id, name) with a unique name each: the name, or with -1, -2 ... after the stem.

    Numbers that existing names hold are passed over; the order is by id.
    """
    parts = rows.withColumns({"stem": F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), "ext": F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 2)})
    names = existing.select("name").distinct()
    held = names.withColumns({"ext": F.regexp_extract("name", r"(\.[^.]*)$", 1), "base": F.regexp_replace("name", r"\.[^.]*$", "")})
    numbered = held.select(F.regexp_extract("base", r"^(.*)-[1-9]\d*$", 1).alias("stem"), "ext", F.expr("try_cast(regexp_extract(base, '-([1-9][0-9]*)$', 1) as bigint)").alias("k")).where("k is not null")
    plain = held.select(F.col("base").alias("stem"), "ext", F.lit(0).cast("long").alias("k"))
    own = parts.select("stem", "ext").distinct()
    taken = numbered.unionByName(plain).join(own, ["stem", "ext"], "left_semi")
    # The nth row of a name gets the nth number that is not taken: of 0 .. rows + taken - 1 there are enough.
    counts = parts.groupBy("stem", "ext").agg(F.count("*").alias("rows")).join(taken.groupBy("stem", "ext").agg(F.count("*").alias("held")), ["stem", "ext"], "left")
    numbers = counts.select("stem", "ext", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") + F.coalesce("held", F.lit(0)) - 1)).alias("k")).join(taken, ["stem", "ext", "k"], "left_anti")
    nth_free = numbers.withColumn("nth", F.row_number().over(Window.partitionBy("stem", "ext").orderBy("k")))
    nth_row = parts.withColumn("nth", F.row_number().over(Window.partitionBy("stem", "ext").orderBy("id")))
    joined = nth_row.join(nth_free, ["stem", "ext", "nth"])
    return joined.select("id", "name", F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("stem", F.lit("-"), F.col("k").cast("string"), "ext")).alias("unique_name"))
