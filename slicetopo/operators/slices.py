"""Slice sequences: neighbours, gaps, spacing, missing slices, volumes, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence(slices: DataFrame, *group: str, signed: bool = False) -> DataFrame:
    """Distinct slices of each group with previous, next and the gap: half the distance of
    the neighbours, the distance to the only one, or null. ``signed``: the distance to a
    previous slice alone is negative."""
    w = Window.partitionBy(*group).orderBy("z")
    out = slices.select(*group, "z").distinct().select(*group, "z", F.lag("z").over(w).alias("previous_z"), F.lead("z").over(w).alias("next_z"))
    gap = F.when(F.col("previous_z").isNotNull() & F.col("next_z").isNotNull(), (F.col("next_z") - F.col("previous_z")) / 2.0).otherwise(F.coalesce((F.col("z") - F.col("previous_z")) * (-1 if signed else 1), F.col("next_z") - F.col("z")).cast("double"))
    return out.withColumn("gap", gap)


def spacing(slices: DataFrame, *group: str) -> DataFrame:
    """Median distance of following slices; 0.01 for fewer than two."""
    seq = sequence(slices, *group)
    return seq.groupBy(*group).agg(F.coalesce(F.median(F.col("next_z") - F.col("z")), F.lit(0.01)).alias("spacing"), F.count("*").alias("n_slices"))


def missing(slices: DataFrame, all_slices: DataFrame, set_col: str = "set_id") -> DataFrame:
    """Slices inside a structure's range on which it has nothing, with the two nearest it
    has below and above."""
    rng = slices.groupBy(set_col, "roi").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    grid = all_slices.select(set_col, "z").distinct().join(rng, set_col).where((F.col("z") >= F.col("lo")) & (F.col("z") <= F.col("hi")))
    have = slices.select(set_col, "roi", "z").distinct().withColumn("own", F.col("z"))
    full = grid.join(have, [set_col, "roi", "z"], "left")
    w = Window.partitionBy(set_col, "roi").orderBy("z")
    down, up = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    inf1, sup1 = F.last("own", True).over(down), F.first("own", True).over(up)
    before = F.array_sort(F.collect_list("own").over(down), lambda a, b: (b - a).cast("int"))
    after = F.collect_list("own").over(up)
    out = full.select(set_col, "roi", "z", "own", inf1.alias("inf1"), F.get(before, F.lit(1)).alias("inf2"), sup1.alias("sup1"), F.get(after, F.lit(1)).alias("sup2"))
    return out.where("own is null").drop("own")


def has_gaps(slices: DataFrame, set_col: str = "set_id") -> DataFrame:
    """(set, roi, n, expected, has_gaps): slices that a structure has and that its set has in
    its range."""
    rng = slices.groupBy(set_col, "roi").agg(F.countDistinct("z").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    every = slices.select(set_col, F.col("z").alias("sz")).distinct()
    out = rng.join(every, set_col).where("sz between lo and hi").groupBy(set_col, "roi", "n").agg(F.count("*").alias("expected"))
    return out.withColumn("has_gaps", F.col("n") < F.col("expected"))


def presence(slices: DataFrame, rois: list[int], set_col: str = "set_id") -> DataFrame:
    """Slice by structure: the distance to each chosen structure's next slice."""
    seq = sequence(slices, set_col, "roi").withColumn("step", F.col("next_z") - F.col("z"))
    return seq.where(F.col("roi").isin(rois)).groupBy(set_col, "z").pivot("roi", rois).agg(F.first("step"))


def trapezoid_volume(areas: DataFrame, *group: str) -> DataFrame:
    """Sum over following slices of mean area times distance, from (group, z, area)."""
    w = Window.partitionBy(*group).orderBy("z")
    step = (F.lead("z").over(w) - F.col("z")) * (F.lead("area").over(w) + F.col("area")) / 2.0
    return areas.select(*group, step.alias("part")).groupBy(*group).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("volume"))


def edge_volumes(edges: DataFrame, *group: str) -> DataFrame:
    """Physical, exterior and hull volumes from contour matches (group, gap, area1, area2,
    hull1, hull2, hole_type): holes subtract, closed holes not from the exterior, none from
    the hull."""
    v = (F.col("area1") + F.col("area2")) / 2 * F.col("gap")
    h = (F.col("hull1") + F.col("hull2")) / 2 * F.col("gap")
    hole, closed = F.col("hole_type") != "None", F.col("hole_type") == "Closed"
    return edges.groupBy(*group).agg(F.sum(F.when(hole, -v).otherwise(v)).alias("physical"), F.sum(F.when(closed, 0.0).when(hole, -v).otherwise(v)).alias("exterior"), F.sum(F.when(hole, 0.0).otherwise(h)).alias("hull"))


def summary(areas: DataFrame, *group: str) -> DataFrame:
    """Volume, number of contours and slices, and the range as text."""
    vol = trapezoid_volume(areas, *group)
    num = areas.groupBy(*group).agg(F.count("*").alias("num_contours"), F.countDistinct("z").alias("num_slices"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    return num.join(vol, list(group)).select(*group, "volume", "num_contours", "num_slices", F.format_string("%d to %d", "lo", "hi").alias("slice_range"))
