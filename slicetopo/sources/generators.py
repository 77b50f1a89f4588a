"""Synthetic contours, as DataFrame expressions: slices come from a sequence, points from
a transform of sines and cosines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import round_value

CONTOURS = "set_id string, roi int, z double, points array<struct<x:double,y:double>>"


def circle(radius: Column, x: float = 0.0, y: float = 0.0, sides: int = 16, places: int = 2) -> Column:
    """An n-gon that starts at the top: x by sine, y by cosine."""
    turn = lambda i: i * F.lit(2 * math.pi / sides)
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: F.struct(F.round(x + radius * F.sin(turn(i)), places).alias("x"), F.round(y + radius * F.cos(turn(i)), places).alias("y")))


def circle_at(radius: float, xs: list[float], x: float = 0.0, y: float = 0.0, tolerance: float = 0.01) -> Column:
    """A circle by its points above given x, and back by those below; beyond the radius the
    height is the tolerance."""
    height = lambda v: F.greatest(F.sqrt(F.greatest(F.lit(radius * radius) - F.pow(v - x, 2), F.lit(0.0))), F.lit(tolerance))
    point = lambda v, sign: F.struct(v.alias("x"), round_value(y + sign * height(v), tolerance).alias("y"))
    at = F.array(*[F.lit(float(v)) for v in xs])
    below = F.reverse(F.transform(at, lambda v: point(v, -1)))
    return F.concat(F.transform(at, lambda v: point(v, 1)), F.slice(below, 2, max(len(xs) - 1, 0)))


def box(width: Column, height: Column, x: float = 0.0, y: float = 0.0) -> Column:
    """Corners from the upper right on, clockwise."""
    return F.array(*[F.struct((F.lit(x) + sx * width / 2).alias("x"), (F.lit(y) + sy * height / 2).alias("y")) for sx, sy in ((1, 1), (1, -1), (-1, -1), (-1, 1))])


def slice_list(spark: SparkSession, height: float, spacing: float, z: float = 0.0) -> DataFrame:
    n = math.ceil(round(height / spacing, 9)) + 1
    return spark.range(n).select(F.round(F.lit(z - height / 2) + F.col("id") * spacing, 4).alias("z"))


def _contours(slices: DataFrame, set_id: str, roi: int, points: Column) -> DataFrame:
    return slices.select(F.lit(set_id).alias("set_id"), F.lit(roi).cast("int").alias("roi"), "z", points.alias("points"))


def _size(x, tolerance: float = 0.01) -> Column:
    """Zero sizes become the tolerance."""
    return F.greatest(x if isinstance(x, Column) else F.lit(float(x)), F.lit(tolerance))


def cuboid(spark, set_id, roi, width, depth, height, spacing, x=0.0, y=0.0, z=0.0) -> DataFrame:
    return _contours(slice_list(spark, height, spacing, z), set_id, roi, box(_size(width), _size(depth), x, y))


def vertical_cylinder(spark, set_id, roi, radius, length, spacing, x=0.0, y=0.0, z=0.0) -> DataFrame:
    return _contours(slice_list(spark, length, spacing, z), set_id, roi, circle(_size(radius), x, y))


def horizontal_cylinder(spark, set_id, roi, radius, length, spacing, x=0.0, y=0.0, z=0.0) -> DataFrame:
    """Along x: each slice is a rectangle of the length and the chord."""
    chord = 2 * F.sqrt(F.greatest(F.lit(radius * radius) - F.pow(F.col("z") - z, 2), F.lit(0.0)))
    return _contours(slice_list(spark, 2 * radius, spacing, z), set_id, roi, box(_size(length), _size(F.round(chord, 2)), x, y))


def sphere(spark, set_id, roi, radius, spacing, x=0.0, y=0.0, z=0.0) -> DataFrame:
    r = F.sqrt(F.greatest(F.lit(radius * radius) - F.pow(F.col("z") - z, 2), F.lit(0.0)))
    return _contours(slice_list(spark, 2 * radius, spacing, z), set_id, roi, circle(_size(r), x, y))


def extruded(spark, set_id, roi, ring: list[tuple[float, float]], height, spacing, z=0.0) -> DataFrame:
    points = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])
    return _contours(slice_list(spark, height, spacing, z), set_id, roi, points)


def body(contours: DataFrame, roi: int = 0, half_width: float = 50.0) -> DataFrame:
    """A box around everything, on every slice of a set."""
    return contours.select("set_id", "z").distinct().select("set_id", F.lit(roi).cast("int").alias("roi"), "z", box(F.lit(2 * half_width), F.lit(2 * half_width)).alias("points"))
