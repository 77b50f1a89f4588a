"""Scalar functions on numbers, rings and text values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_value(x: Column, tolerance: float) -> Column:
    """The quotient by the tolerance, rounded to the tolerance's places, times it, rounded
    again; ties to even. So the result is finer than a multiple. 0 changes nothing."""
    if tolerance < 0:
        raise ValueError("tolerance is negative")
    if tolerance == 0:
        return x
    places = -int(math.log10(tolerance)) + 1
    return F.bround(F.bround(x / tolerance, places) * tolerance, places)


def round_one_up(x: Column) -> Column:
    """Away from zero to one significant digit."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.ceil(F.bround(F.abs(x) / p, 9)) * p)


def floor_to_grid(x: Column, tolerance: float) -> Column:
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    return F.floor(x / tolerance) * tolerance


def floor_ring(ring: Column, tolerance: float) -> Column:
    return F.transform(ring, lambda p: F.struct(floor_to_grid(p["x"], tolerance).alias("x"), floor_to_grid(p["y"], tolerance).alias("y")))


def round_ring(ring: Column, tolerance: float) -> Column:
    return F.transform(ring, lambda p: F.struct(round_value(p["x"], tolerance).alias("x"), round_value(p["y"], tolerance).alias("y")))


def _turned(ring: Column) -> Column:
    """The ring from its second point on, and the first at the end."""
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))


def _cross(ring: Column) -> Column:
    return F.zip_with(ring, _turned(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    return F.abs(_total(_cross(ring))) / 2


def ring_centroid(ring: Column) -> Column:
    """Struct of x and y, by area; null for a ring without area."""
    twice = _total(_cross(ring))
    part = lambda c: _total(F.zip_with(ring, _turned(ring), lambda p, q: (p[c] + q[c]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    return F.when(twice != 0, F.struct((part("x") / (3 * twice)).alias("x"), (part("y") / (3 * twice)).alias("y")))


def ring_bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def slice_key(z: Column) -> Column:
    """The join key of a slice position; positions are never joined as doubles."""
    return F.round(z * 10000).cast("long")


def slice_label(z: Column) -> Column:
    return F.format_string("%.4f", z)


def shown_list(x: Column) -> Column:
    """A list as JSON; null is empty text."""
    return F.coalesce(F.to_json(x), F.lit(""))


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y", "on"), F.lit(False))


def shown(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def hex_to_rgba(code: Column, alpha: float = 1.0) -> Column:
    """A colour of six digits with alpha to three places; other codes without their #."""
    bare = F.ltrim(code, F.lit("#"))
    part = lambda i: F.conv(F.substring(bare, i, 2), 16, 10)
    shown_ = F.concat(F.lit("rgba("), F.concat_ws(", ", part(1), part(3), part(5), F.lit(f"{alpha:.3f}")), F.lit(")"))
    return F.when(F.length(bare) == 6, shown_).otherwise(bare)


def rgb_to_hex(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c)), 2, "0") for c in (red, green, blue)])


def to_millimetres(x: Column, unit: Column) -> Column:
    """Centimetres, or values under 1, become millimetres."""
    return F.when((F.lower(unit) == "cm") | (x < 1.0), x * 10).otherwise(x)


def to_centigray(x: Column, unit: Column) -> Column:
    """Gray becomes centigray unless the unit is cGy or %, or the value is over 100."""
    return F.when(unit.isin("cGy", "%") | (x > 100), x).otherwise(x * 100)


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def joined(separator: str, *columns: Column) -> Column:
    return F.concat_ws(separator, *[F.nullif(F.trim(c), F.lit("")) for c in columns])


def fold_synonyms(x: Column, names: list[str], to: str, any_case: bool = True) -> Column:
    return F.when(F.lower(x).isin([n.lower() for n in names]) if any_case else x.isin(names), F.lit(to)).otherwise(x)
