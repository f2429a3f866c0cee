"""Plans over sizes and ordered groups: tiles, budgets, even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.functions.geometry import fit_scale, scaled, spread_positions


def scale_to_budget(rows: DataFrame, group: str, budget: int, width: str = "width", height: str = "height") -> DataFrame:
    """Every member of a group above the pixel budget scaled by the same factor."""
    total = F.sum(F.col(width) * F.col(height)).over(Window.partitionBy(group))
    factor = F.when(total > budget, F.sqrt(F.lit(float(budget)) / total)).otherwise(1.0)
    return rows.withColumn("_factor", factor).withColumns({width: scaled(F.col(width), F.col("_factor")), height: scaled(F.col(height), F.col("_factor"))}).drop("_factor")


def plan_tiles(items: DataFrame, most_pixels: int = 1_000_000, most_side: int = 1600, least_aspect: float = 2.5, least_side: int = 1600, most_tiles: int = 4, overlap: int = 40, most_total: int | None = None) -> DataFrame:
    """A row for each box of each picture: id, tile, left, top, right, bottom, out_width, out_height.

    A long picture is cut along its long side into overlapping boxes that are scaled to the pixel limit
    one by one and then together to ``most_total`` pixels; any other picture is one box that fits within both limits.
    """
    known = items.where("width > 0 and height > 0").select("id", "width", "height", F.greatest("width", "height").alias("long"), F.least("width", "height").alias("short"))
    wanted = F.least(F.lit(most_tiles), F.ceil(F.col("long") / F.greatest(F.lit(1), F.floor(F.lit(most_pixels) / F.col("short")))))
    tiled = (F.col("long") / F.col("short") >= least_aspect) & (F.col("long") >= least_side)
    counted = known.withColumn("tiles", F.when(tiled, wanted).otherwise(1).cast("long"))
    boxes = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    step = F.ceil(F.col("long") / F.col("tiles"))
    begin = F.greatest(F.lit(0), F.col("tile") * step - F.when(F.col("tile") > 0, overlap).otherwise(0))
    end = F.least(F.col("long"), (F.col("tile") + 1) * step + F.when(F.col("tile") < F.col("tiles") - 1, overlap).otherwise(0))
    upright = F.col("height") >= F.col("width")
    placed = boxes.withColumns({"begin": begin, "end": end}).select(
        "id", "tile", "tiles",
        F.when(upright, 0).otherwise(F.col("begin")).cast("long").alias("left"), F.when(upright, F.col("begin")).otherwise(0).cast("long").alias("top"),
        F.when(upright, F.col("width")).otherwise(F.col("end")).cast("long").alias("right"), F.when(upright, F.col("end")).otherwise(F.col("height")).cast("long").alias("bottom"),
    )
    sized = placed.withColumns({"w": F.col("right") - F.col("left"), "h": F.col("bottom") - F.col("top")})
    alone = F.col("tiles") == 1
    factor = F.when(alone, fit_scale(F.col("w"), F.col("h"), most_pixels, most_side)).otherwise(fit_scale(F.col("w"), F.col("h"), most_pixels))
    fitted = sized.withColumn("f", factor).withColumns({"out_width": scaled(F.col("w"), F.col("f")), "out_height": scaled(F.col("h"), F.col("f"))})
    return (scale_to_budget(fitted, "id", most_total, "out_width", "out_height") if most_total else fitted).select("id", "tile", "left", "top", "right", "bottom", "out_width", "out_height")


def evenly_spaced_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """At most ``n`` rows of each group at evenly spread places of its order, first and last among them."""
    total = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    placed = rows.withColumns({"place": place.cast("long"), "total": total})
    return placed.where(F.array_contains(spread_positions(F.lit(n).cast("long"), F.col("total")), F.col("place"))).drop("total")


def timeline_instants(duration: str, n: int) -> Column:
    """Array of ``n`` instants from 0 to 0.2 s before the end, in milliseconds; the middle if n is 1."""
    if n == 1:
        return F.array(F.round(F.col(duration) / 2, 3))
    end = F.greatest(F.lit(0.0), F.col(duration) - 0.2)
    return F.array(*[F.round(F.lit(float(i)) * end / (n - 1), 3) for i in range(n)])


def timeline_sample(events: DataFrame, group: str, at: str, value: str, n: int) -> DataFrame:
    """For each group ``n`` instants over its time span (seconds from its first event) and the last event up to each.

    Instants and events of a group meet by one sort: each instant takes the value last seen before it.
    """
    ends = events.groupBy(group).agg(F.min(at).alias("zero"), (F.max(at) - F.min(at)).alias("span"))
    instants = ends.select(group, "zero", F.posexplode(timeline_instants("span", n)).alias("i", "instant"))
    asked = instants.select(group, "i", "instant", (F.col("zero") + F.col("instant")).alias("t"), F.lit(None).cast("long").alias("value"), F.lit(1).alias("kind"))
    seen = events.select(group, F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("instant"), F.col(at).alias("t"), F.col(value).cast("long").alias("value"), F.lit(0).alias("kind"))
    upto = Window.partitionBy(group).orderBy("t", "kind", "value", "i").rowsBetween(Window.unboundedPreceding, 0)
    merged = asked.unionByName(seen).withColumn("last", F.last("value", ignorenulls=True).over(upto))
    return merged.where("kind = 1").select(group, "i", "instant", F.col("last").alias("value"))
