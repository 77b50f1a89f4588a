"""Structures with holes, islands, notches and several regions, derived from `supplier`.

Each supplier is a structure of boxes on whole numbers: an outer box, which may have a hole
through all slices or closed at both ends, an island in the hole, a notch in its upper side,
and a second box beside it. Such structures have all relations, and their areas, volumes and
relations follow from counting unit squares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suppliers of a set.
PER_SET = 24
PARTS = ("outer", "hole", "island", "notch", "second")
#: Each kind's boxes (x0, x1, y0, y1) and slices (first, last); ``a`` is the number among
#: its kind, ``s`` the set modulo 3. Fixed values of this test source.
KINDS = (
    {"outer": "2, 14, 2, 14", "hole": "4 + a, 12, 4, 12 - a % 2", "z": "a % 2, a % 2 + 6", "closed": "true"},
    {"outer": "6, 8 + a, 5 + s, 8 + s", "z": "2 + a % 2, 3 + a % 2 + s % 2"},
    {"outer": "3 + a, 15, 3, 15", "notch": "6 + a, 12, 7, 15", "z": "0, 3 + a % 2"},
    {"outer": "8, 10 + a % 3, if(a = 3, 4, 9 + s % 2), if(a = 3, 6, 12)", "z": "1, 2 + a % 2"},
    {"outer": "1 + a, 17, 1, 17 - a", "hole": "5, 13, 5, 12", "island": "7, 9 + a, 7, 9", "z": "0, 2 + a"},
    {"outer": "2 + a, 6 + a, 4, 8", "second": "9 + a, 13 + a, 4 + s, 11", "z": "s, s + 2"},
)


def frames(suppliers: DataFrame) -> DataFrame:
    """(set_id, roi, kind, a box for each part or null, z0, z1, closed). Every eighth
    structure has a twin, numbered 1,000 higher."""
    k = suppliers.select(F.expr(f"cast(s_suppkey div {PER_SET} as string)").alias("set_id"), F.expr(f"cast(s_suppkey % {PER_SET} as int)").alias("j"), F.expr(f"cast(s_suppkey div {PER_SET} % 3 as int)").alias("s"))
    k = k.withColumns({"kind": F.expr(f"j % {len(KINDS)}"), "a": F.expr(f"j div {len(KINDS)}")})

    def pick(part: str, none: str = "null") -> Column:
        return F.expr("case kind " + " ".join(f"when {i} then {f'array({d[part]})' if part not in ('closed',) else d[part]}" for i, d in enumerate(KINDS) if part in d) + f" else {none} end")

    out = k.select("set_id", "j", "kind", *[pick(p).cast("array<int>").alias(p) for p in PARTS], pick("z").cast("array<int>").alias("z"), pick("closed", "false").alias("closed"))
    twin = F.explode(F.when(F.col("j") % 8 == 0, F.array("j", F.col("j") + 1000)).otherwise(F.array("j")))
    return out.withColumn("roi", twin).select("set_id", F.col("roi").cast("int").alias("roi"), "kind", *PARTS, F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1"), "closed")


def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def _box(part: str) -> Column:
    b = F.col(part)
    return _ring((b[1], b[3]), (b[1], b[2]), (b[0], b[2]), (b[0], b[3]))


def contours(suppliers: DataFrame) -> DataFrame:
    """(set_id, roi, z, points) of every ring; a notch is part of the outer ring, a closed hole
    is missing on the first and the last slice."""
    f = frames(suppliers).withColumn("z", F.explode(F.sequence("z0", "z1")))
    o, n = F.col("outer"), F.col("notch")
    notched = _ring((o[0], o[2]), (o[0], o[3]), (n[0], n[3]), (n[0], n[2]), (n[1], n[2]), (n[1], n[3]), (o[1], o[3]), (o[1], o[2]))
    inner = ~F.col("closed") | ((F.col("z") > F.col("z0")) & (F.col("z") < F.col("z1")))
    rings = F.array_compact(F.array(F.when(n.isNotNull(), notched).otherwise(_box("outer")), F.when(F.col("hole").isNotNull() & inner, _box("hole")), F.when(F.col("island").isNotNull(), _box("island")), F.when(F.col("second").isNotNull(), _box("second"))))
    return f.select("set_id", "roi", F.col("z").cast("double").alias("z"), F.explode(rings).alias("points"))


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contours(spark.read.parquet(f"{sf_dir}/supplier.parquet"))
