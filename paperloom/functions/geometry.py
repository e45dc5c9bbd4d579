"""Polygon rules over ``array<struct<x, y>>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _points(polygon: Column, x, y) -> Column:
    return F.transform(polygon, lambda p: F.struct(x(p["x"]).alias("x"), y(p["y"]).alias("y")))


def percent_to_normalised(polygon: Column) -> Column:
    return _points(polygon, lambda x: x / 100.0, lambda y: y / 100.0)


def pixel_to_percent(polygon: Column, width: Column, height: Column) -> Column:
    return _points(polygon, lambda x: F.try_divide(x, width) * 100.0, lambda y: F.try_divide(y, height) * 100.0)


def normalised_to_pixel(polygon: Column, width: Column, height: Column) -> Column:
    """Scaled up and truncated toward zero; a coordinate that is no number, or too large for a pixel, becomes null."""
    return _points(polygon, lambda x: (x * width).try_cast("int"), lambda y: (y * height).try_cast("int"))


def from_pairs(pairs: Column) -> Column:
    """``array<array<double>>`` points as structs; what a short pair lacks is null."""
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def min_x(polygon: Column) -> Column:
    return F.array_min(F.transform(polygon, lambda p: p["x"]))


def min_y(polygon: Column) -> Column:
    return F.array_min(F.transform(polygon, lambda p: p["y"]))


def max_x(polygon: Column) -> Column:
    return F.array_max(F.transform(polygon, lambda p: p["x"]))


def max_y(polygon: Column) -> Column:
    return F.array_max(F.transform(polygon, lambda p: p["y"]))


def reading_order(polygon: Column) -> list[Column]:
    """Top to bottom, then left to right; the two minima are independent."""
    return [min_y(polygon), min_x(polygon)]


def bounds(polygon: Column) -> Column:
    return F.struct(
        min_x(polygon).alias("left"),
        min_y(polygon).alias("top"),
        max_x(polygon).alias("right"),
        max_y(polygon).alias("bottom"),
    )


def label_line(class_id: Column, polygon: Column) -> Column:
    """``class x y x y ...`` with six decimals."""
    pairs = F.transform(polygon, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"]))
    return F.concat_ws(" ", class_id.cast("string"), F.array_join(pairs, " "))
