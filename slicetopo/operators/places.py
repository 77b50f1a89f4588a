"""Dense ranks without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def dense_places(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, place) of the distinct keys of each group, by rising key from 1. Keys are
    dealt over tasks by ranges and ordered within them; what stands before a range comes from
    the counts of the ranges, a table of ranges times groups at most."""
    dealt = written(rows.select(group, key).distinct().repartitionByRange(F.col(group), F.col(key)).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", group).orderBy(key))
    got = dealt.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    return got.select(group, key, (within + F.col("_before")).alias("place"))
