"""Sizes, boxes and evenly spread positions as column arithmetic (halves round to even)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_scale(width: Column, height: Column, most_pixels: int, most_side: int | None = None) -> Column:
    """The factor, at most 1, that brings a picture within both limits."""
    factors = [F.lit(1.0), F.sqrt(F.lit(float(most_pixels)) / (width * height))]
    if most_side:
        factors.append(F.lit(float(most_side)) / F.greatest(width, height))
    return F.least(*factors)


def scaled(side: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(side * factor, 0).cast("long"))


def fit_within(width: Column, height: Column, most_pixels: int, most_side: int) -> Column:
    """struct(width, height) that fits, never larger than before and at least one pixel each."""
    factor = fit_scale(width, height, most_pixels, most_side)
    return F.struct(scaled(width, factor).alias("width"), scaled(height, factor).alias("height"))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), width / height)


def spread_positions(n: Column, total: Column) -> Column:
    """Array of at most ``n`` distinct positions from 0 to total - 1, first and last among them."""
    count = F.least(n, total)
    many = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.bround(i * (total - 1) / (count - 1), 0).cast("long")))
    return F.when(count <= 0, F.array().cast("array<bigint>")).when(count == 1, F.array(F.lit(0).cast("long"))).otherwise(many)


def snap_size(size: Column, sizes: list[int]) -> Column:
    """The configured size nearest to ``size``, the smaller one of two."""
    return F.array_min(F.transform(F.array(*map(F.lit, sizes)), lambda s: F.struct(F.abs(s - size).alias("away"), s.alias("size"))))["size"]
