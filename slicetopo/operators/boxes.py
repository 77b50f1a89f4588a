"""Box structures: axis-parallel boxes on slices, whose relations have closed forms.

Two table shapes of the driver become structures. Both are cut into structure sets of
bounded size, as real sets are, so pairs grow with the input and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..plans import definitions as D
from ..session import spread, written

#: Structures in a set.
SET_OF_SLICES, SET_OF_BOXES = 40, 60


def slice_boxes(lineitem: DataFrame) -> DataFrame:
    """(set_id, roi, z, x0, x1, y0, y1): one box per (structure, slice)."""
    key = ["set_id", "roi", "z"]
    rows = lineitem.select(F.floor(F.col("l_suppkey") / SET_OF_SLICES).cast("long").alias("set_id"), (F.col("l_suppkey") % SET_OF_SLICES).cast("long").alias("roi"), F.col("l_linenumber").cast("long").alias("z"), F.struct("l_orderkey", "l_partkey", "l_quantity").alias("r"))
    # The first row by order and part: a minimum, combined before the shuffle.
    first = rows.groupBy(*key).agg(F.min("r").alias("r"))
    x0, y0 = F.floor(F.col("r.l_quantity") / 4).cast("long"), (F.col("r.l_partkey") % 8).cast("long")
    return first.select(*key, x0.alias("x0"), (x0 + 2 * (F.col("r.l_partkey") % 5 + 1)).cast("long").alias("x1"), y0.alias("y0"), (y0 + 2 * (F.col("r.l_orderkey") % 5 + 1)).cast("long").alias("y1"))


#: Two boxes of a slice, moved so that both begin at 0 at least.
KIND = [f"{c}_{x}" for x in "ab" for c in ("x0", "x1", "y0", "y1")]


def moved_pairs(boxes: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, z and the bounds of both) of every pair of boxes of a slice, moved by
    whole numbers. The boxes are written once."""
    b = spread(written(boxes), "set_id", "z")
    side = lambda x: b.select("set_id", F.col("roi").alias(f"roi_{x}"), "z", *[F.col(c).alias(f"{c}_{x}") for c in ("x0", "x1", "y0", "y1")])
    low = {u: F.least(f"{u}0_a", f"{u}0_b") for u in "xy"}
    return side("a").join(side("b"), ["set_id", "z"]).where("roi_a < roi_b").select("set_id", "roi_a", "roi_b", "z", *[(F.col(c) - low[c[0]]).alias(c) for c in KIND])


def by_kind(pairs: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pairs`` with what ``answer`` gives for their distinct values of ``KIND``: pairs that differ
    by a move are asked for once in the whole job. Boxes of a bounded range have a bounded number
    of kinds, however many pairs there are."""
    got = answer(spread(pairs.select(*KIND).distinct(), *KIND)).withColumnsRenamed({c: f"_{c}" for c in KIND})
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KIND))
    return pairs.join(got, on).drop(*KIND, *[f"_{c}" for c in KIND])


def solid_boxes(supplier: DataFrame) -> DataFrame:
    """(set_id, roi, x0, x1, y0, y1, z0, z1, volume): one box per structure; of every
    fifteenth structure there is a copy, 1000 higher."""
    k = F.col("k")
    s = supplier.select(F.floor(F.col("s_suppkey") / SET_OF_BOXES).cast("long").alias("set_id"), (F.col("s_suppkey") % SET_OF_BOXES).cast("long").alias("k"))
    copies = s.where(k % 15 == 0).select("set_id", "k", (k + 1000).alias("roi"))
    all_ = s.select("set_id", "k", k.alias("roi")).unionByName(copies)
    x0, y0, z0 = k % 6, (7 * k) % 5, k % 3
    x1, y1, z1 = x0 + 2 * (1 + k % 4), y0 + 2 * (1 + F.floor(k / 4) % 4), z0 + 1 + F.floor(k / 3) % 3
    volume = (x1 - x0) * (y1 - y0) * (z1 - z0 + 1)
    return all_.select("set_id", "roi", *[c.cast("long").alias(n) for n, c in zip(("x0", "x1", "y0", "y1", "z0", "z1", "volume"), (x0, x1, y0, y1, z0, z1, volume), strict=True)])


def box_bits(a: str, b: str) -> Column:
    """27 bits of two boxes, of the four cells the classifier reads; exterior and hull are
    the box itself."""
    c = lambda side, name: F.col(f"{side}.{name}")
    ox = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    oy = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    outside = lambda p, q: (c(p, "x0") < c(q, "x0")) | (c(p, "x1") > c(q, "x1")) | (c(p, "y0") < c(q, "y0")) | (c(p, "y1") > c(q, "y1"))
    shared = lambda axis: (c(a, f"{axis}0") == c(b, f"{axis}0")) | (c(a, f"{axis}0") == c(b, f"{axis}1")) | (c(a, f"{axis}1") == c(b, f"{axis}0")) | (c(a, f"{axis}1") == c(b, f"{axis}1"))
    nine = bits.matrix(II=(ox > 0) & (oy > 0), IE=outside(a, b), EI=outside(b, a), BB=(shared("x") & (oy > 0)) | (shared("y") & (ox > 0)))
    return bits.bands(nine, nine, nine)


def pair_bits(a: str, b: str) -> Column:
    """27 bits of two solid boxes (structs or aliases) over all their slices: those that both
    have are alike, and which has some alone follows from the ranges."""
    c = lambda side, name: F.col(f"{side}.{name}")
    meet = F.greatest(c(a, "z0"), c(b, "z0")) <= F.least(c(a, "z1"), c(b, "z1"))
    beyond = lambda p, q, only: F.when((c(p, "z0") < c(q, "z0")) | (c(p, "z1") > c(q, "z1")), F.lit(only)).otherwise(0)
    both = F.when(meet, box_bits(a, b)).otherwise(0)
    return both.bitwiseOR(beyond(a, b, bits.ONLY_A)).bitwiseOR(beyond(b, a, bits.ONLY_B)).cast("int")


def slice_relations(boxes: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, z, bits, relation) of every pair on every slice."""
    a, b = boxes.alias("a"), boxes.alias("b")
    pairs = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.z") == F.col("b.z")) & (F.col("a.roi") < F.col("b.roi")))
    out = pairs.select(F.col("a.set_id").alias("set_id"), F.col("a.roi").alias("roi_a"), F.col("b.roi").alias("roi_b"), F.col("a.z").alias("z"), box_bits("a", "b").alias("bits"))
    return out.withColumn("relation", D.classify(F.col("bits")))


def pair_relations(boxes: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, bits, relation): bits of all slices of a pair, or-ed. The
    larger structure comes first; equal volumes follow their numbers."""
    on = boxes.withColumn("z", F.explode(F.sequence("z0", "z1")))
    first = (F.col("a.volume") > F.col("b.volume")) | ((F.col("a.volume") == F.col("b.volume")) & (F.col("a.roi") < F.col("b.roi")))
    a, b = on.alias("a"), on.alias("b")
    both = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.z") == F.col("b.z")) & first)
    keys = [F.col("a.set_id").alias("set_id"), F.col("a.roi").alias("roi_a"), F.col("b.roi").alias("roi_b")]
    both = both.select(*keys, box_bits("a", "b").alias("bits"))
    # Slices with one side only: which side has some follows from the ranges.
    x, y = boxes.alias("a"), boxes.alias("b")
    alone_a = (F.col("a.z0") < F.col("b.z0")) | (F.col("a.z1") > F.col("b.z1"))
    alone_b = (F.col("b.z0") < F.col("a.z0")) | (F.col("b.z1") > F.col("a.z1"))
    alone = F.when(alone_a, F.lit(bits.ONLY_A)).otherwise(0).bitwiseOR(F.when(alone_b, F.lit(bits.ONLY_B)).otherwise(0))
    one = x.join(y, (F.col("a.set_id") == F.col("b.set_id")) & first).select(*keys, alone.cast("int").alias("bits"))
    merged = both.unionByName(one).groupBy("set_id", "roi_a", "roi_b").agg(F.bit_or("bits").alias("bits"))
    return merged.withColumn("relation", D.classify(F.col("bits")))


def histogram(relations: DataFrame) -> DataFrame:
    """(relation, rank, n), most specific relation first."""
    return relations.groupBy("relation").agg(F.count("*").alias("n")).select("relation", D.rank(F.col("relation")).alias("rank"), "n").orderBy("rank", F.desc("n"))


def matrix_long(relations: DataFrame, structures: DataFrame) -> DataFrame:
    """(set_id, row_roi, col_roi, relation, is_logical, intermediates): both directions and the
    diagonal. The reverse of a cell is its complement, and follows from others if it does."""
    follows = [F.col("is_logical") if "is_logical" in relations.columns else F.lit(False).alias("is_logical")]
    follows.append(F.col("intermediates").cast("array<long>").alias("intermediates") if "intermediates" in relations.columns else F.array().cast("array<long>").alias("intermediates"))
    forward = relations.select("set_id", F.col("roi_b").alias("row_roi"), F.col("roi_a").alias("col_roi"), "relation", *follows)
    complement = F.coalesce(F.nullif(D.lookup(F.col("relation"), "complement"), F.lit("")), F.lit("UNKNOWN"))
    back = relations.select("set_id", F.col("roi_a").alias("row_roi"), F.col("roi_b").alias("col_roi"), complement.alias("relation"), *follows)
    diagonal = structures.select("set_id", F.col("roi").alias("row_roi"), F.col("roi").alias("col_roi"), F.lit("EQUAL").alias("relation"), F.lit(False).alias("is_logical"), F.array().cast("array<long>").alias("intermediates"))
    return forward.unionByName(back).unionByName(diagonal)


def matrix_wide(long: DataFrame, rois: list[int], symbols: bool = False, rows: list[int] | None = None) -> DataFrame:
    """The matrix of chosen structures, a column each; ``rows``: those of its rows, all if none."""
    cell = D.lookup(F.col("relation"), "symbol" if symbols else "label")
    if rows is not None:
        long = long.where(F.col("row_roi").isin(rows))
    return long.where(F.col("col_roi").isin(rois)).withColumn("cell", cell).groupBy("set_id", "row_roi").pivot("col_roi", rois).agg(F.first("cell"))


def cumulative(slices: DataFrame) -> DataFrame:
    """Relation of the slices so far, along each pair."""
    along = Window.partitionBy("set_id", "roi_a", "roi_b").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    return slices.select("set_id", "roi_a", "roi_b", "z", D.classify(F.bit_or("bits").over(along)).alias("relation"))


def volume_rank(boxes: DataFrame) -> DataFrame:
    order = Window.partitionBy("set_id").orderBy(F.desc("volume"), "roi")
    return boxes.select("set_id", "roi", "volume", F.row_number().over(order).cast("long").alias("place"))


def box_metrics(boxes: DataFrame, relations: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, relation, gap2, overlap_volume, dice_permille, margin, widest)
    of each pair: squared least distance, volume in common, Dice coefficient, and least and
    largest margin of a structure inside another."""
    a, b = boxes.alias("a"), boxes.alias("b")
    r = relations.alias("r")
    j = r.join(a, (F.col("r.set_id") == F.col("a.set_id")) & (F.col("r.roi_a") == F.col("a.roi"))).join(b, (F.col("r.set_id") == F.col("b.set_id")) & (F.col("r.roi_b") == F.col("b.roi")))
    gap = lambda u: F.greatest(F.col(f"a.{u}0") - F.col(f"b.{u}1"), F.col(f"b.{u}0") - F.col(f"a.{u}1"), F.lit(0))
    over = lambda u, e=0: F.greatest(F.least(F.col(f"a.{u}1"), F.col(f"b.{u}1")) - F.greatest(F.col(f"a.{u}0"), F.col(f"b.{u}0")) + e, F.lit(0))
    common = over("x") * over("y") * over("z", 1)
    sides = [F.col("b.x0") - F.col("a.x0"), F.col("a.x1") - F.col("b.x1"), F.col("b.y0") - F.col("a.y0"), F.col("a.y1") - F.col("b.y1")]
    inside = F.col("r.relation").isin("CONTAINS", "PARTITIONED", "EQUAL")
    return j.select("r.set_id", "r.roi_a", "r.roi_b", "r.relation", (gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z")).alias("gap2"), common.alias("overlap_volume"), F.floor(2000 * common / (F.col("a.volume") + F.col("b.volume"))).cast("long").alias("dice_permille"), F.when(inside, F.least(*sides)).alias("margin"), F.when(inside, F.greatest(*sides)).alias("widest"))


def nearest_slice(boxes: DataFrame) -> DataFrame:
    """(set_id, roi, z, before, after, nearest): a structure's nearest other slices, the
    earlier one where both are as near."""
    w = Window.partitionBy("set_id", "roi").orderBy("z")
    out = boxes.select("set_id", "roi", "z", F.lag("z").over(w).alias("before"), F.lead("z").over(w).alias("after"))
    down, up = F.col("z") - F.col("before"), F.col("after") - F.col("z")
    return out.withColumn("nearest", F.when(down.isNull(), F.col("after")).when(up.isNull() | (down <= up), F.col("before")).otherwise(F.col("after")))


def components_of_structures(boxes: DataFrame) -> DataFrame:
    """(set_id, roi, n_regions): boxes on following slices belong together where they
    overlap; a run of slices is one region, so regions are the breaks plus one."""
    w = Window.partitionBy("set_id", "roi").orderBy("z")
    p = lambda c: F.lag(c).over(w)
    joined = (p("z") == F.col("z") - 1) & (F.least("x1", p("x1")) > F.greatest("x0", p("x0"))) & (F.least("y1", p("y1")) > F.greatest("y0", p("y0")))
    return boxes.withColumn("starts", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).groupBy("set_id", "roi").agg(F.sum("starts").cast("long").alias("n_regions"))


def region_pair_relations(boxes: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, region_a, region_b, bits, relation) of every pair of regions, that
    is of runs of overlapping boxes on following slices, over the slices that both have."""
    w = Window.partitionBy("set_id", "roi").orderBy("z")
    p = lambda c: F.lag(c).over(w)
    joined = (p("z") == F.col("z") - 1) & (F.least("x1", p("x1")) > F.greatest("x0", p("x0"))) & (F.least("y1", p("y1")) > F.greatest("y0", p("y0")))
    starts = boxes.withColumn("starts", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    own = starts.withColumn("region", F.concat_ws(".", "roi", F.sum("starts").over(w)))
    a, b = own.alias("a"), own.alias("b")
    met = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.z") == F.col("b.z")) & (F.col("a.roi") < F.col("b.roi")))
    out = met.select(F.col("a.set_id").alias("set_id"), F.col("a.roi").alias("roi_a"), F.col("b.roi").alias("roi_b"), F.col("a.region").alias("region_a"), F.col("b.region").alias("region_b"), box_bits("a", "b").alias("bits"))
    merged = out.groupBy("set_id", "roi_a", "roi_b", "region_a", "region_b").agg(F.bit_or("bits").alias("bits"))
    return merged.withColumn("relation", D.classify(F.col("bits")))


def logical(relations: DataFrame, kinds: tuple[str, ...] = ("CONTAINS",)) -> DataFrame:
    """(set_id, roi_a, roi_b, is_logical, via, intermediates): an edge of a transitive relation
    is logical if its ends are linked through others too; intermediates are the structures
    between, via the smallest of them. One self-join: for a transitive relation a longer path
    has a shorter one."""
    e = relations.where(F.col("relation").isin(*kinds)).select("set_id", "roi_a", "roi_b")
    p, q = e.alias("p"), e.alias("q")
    two = p.join(q, (F.col("p.set_id") == F.col("q.set_id")) & (F.col("p.roi_b") == F.col("q.roi_a"))).groupBy(F.col("p.set_id").alias("s"), F.col("p.roi_a").alias("x"), F.col("q.roi_b").alias("y")).agg(F.min("p.roi_b").alias("via"), F.sort_array(F.collect_set("p.roi_b")).alias("intermediates"))
    return e.join(two, (F.col("set_id") == F.col("s")) & (F.col("roi_a") == F.col("x")) & (F.col("roi_b") == F.col("y")), "left").select("set_id", "roi_a", "roi_b", F.col("via").isNotNull().alias("is_logical"), "via", F.coalesce("intermediates", F.array().cast("array<long>")).alias("intermediates"))


def equal_components(relations: DataFrame, boxes: DataFrame) -> DataFrame:
    """(set_id, roi, canonical): structures that equal each other share their smallest. EQUAL
    is an equivalence, so every member sees the smallest directly."""
    e = relations.where("relation = 'EQUAL'")
    both = e.select("set_id", F.col("roi_a").alias("roi"), F.col("roi_b").alias("other")).unionByName(e.select("set_id", F.col("roi_b").alias("roi"), F.col("roi_a").alias("other")))
    low = both.groupBy("set_id", "roi").agg(F.min("other").alias("low"))
    return boxes.select("set_id", "roi").join(low, ["set_id", "roi"], "left").select("set_id", "roi", F.least("roi", F.coalesce("low", "roi")).alias("canonical"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
