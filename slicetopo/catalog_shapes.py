"""Registered queries about shapes, and about structures with holes and several regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import bits, grammar, scalars
from .operators import boxes as B
from .operators import interpolation, shapes, structures, tolerance
from .plans import definitions as D
from .session import spread, written
from .sources import frames
from .sources import generators as G


def _flat(*corners: tuple[str, str]):
    return F.array(*[F.expr(c).cast("double") for xy in corners for c in xy])


_box = lambda: _flat(("x1", "y1"), ("x1", "y0"), ("x0", "y0"), ("x0", "y1"))


KEYS = ["set_id", "roi_a", "roi_b", "z"]


def _box_pairs(s, d):
    """Pairs of boxes of a slice, moved to the origin."""
    return B.moved_pairs(B.slice_boxes(B.read(s, d, "lineitem")))


def _as_regions(kinds):
    """Kinds of pairs of boxes, as regions."""
    ring = lambda x: _flat(*[(f"{u}_{x}", f"{v}_{x}") for u, v in (("x1", "y1"), ("x1", "y0"), ("x0", "y0"), ("x0", "y1"))])
    return kinds.select(*B.KIND, *[c.alias(f"{x}_{n}") for x in "ab" for n, c in (("ops", F.lit("+")), ("n", F.array(F.lit(4))), ("xy", ring(x)))])


def tolerance_relations(s, d):
    """Relations of boxes whose boundaries are a unit wide."""
    return B.by_kind(_box_pairs(s, d), lambda k: tolerance.relations_within(_as_regions(k), B.KIND, 0.5)).select(*KEYS, "bits")


def structure_shapes(s, d):
    """Polygons of the parts of every pair of boxes of a slice."""
    out = B.by_kind(_box_pairs(s, d), lambda k: shapes.measured(_as_regions(k), B.KIND))
    return out.select(*KEYS, "part", "n_polygons", "n_holes", F.round("area").cast("long").alias("area"))


def interpolated_boxes(s, d):
    """Half-way polygons of the boxes of structures; large ones have a hole."""
    b = B.slice_boxes(B.read(s, d, "lineitem"))
    hole = _flat(("x1 - 1", "y1 - 1"), ("x1 - 1", "y0 + 1"), ("x0 + 1", "y0 + 1"), ("x0 + 1", "y1 - 1"))
    none = F.array().cast("array<array<double>>")
    own = b.select("set_id", "roi", F.col("z").cast("double").alias("z"), _box().alias("shell"), F.when(F.expr("x1 - x0 >= 4 and y1 - y0 >= 4"), F.array(hole)).otherwise(none).alias("holes"))
    ahead = interpolation.next_polygons(own).withColumn("two_holes", none)
    return interpolation.between(ahead, ["set_id", "roi", "z"]).select("set_id", "roi", "z", F.size("holes").cast("long").alias("n_holes"), F.round("area", 6).alias("area"))


def _nodes(s, d):
    """Contours and caps of the frames, written once for all that follows."""
    return written(structures.nodes(frames.read(s, d)))


def frame_contours(s, d):
    own = _nodes(s, d).where("not is_made and problem is null")
    return own.select("set_id", "roi", "z", "area", "is_hole", "hole_type", F.concat(F.col("roi").cast("string"), "label").alias("region"))


def frame_volumes(s, d):
    return structures.volumes(_nodes(s, d))


def frame_relations(s, d):
    own = _nodes(s, d)
    got = structures.relations(written(structures.region_slices(own)), structures.volumes(own))
    return got.select("set_id", "roi_a", "roi_b", "relation", D.classify(bits.transpose(F.col("bits"))).alias("reverse"))


def frame_regions(s, d):
    own = _nodes(s, d)
    return structures.region_relations(structures.regions(own), structures.volumes(own)).select("set_id", "roi_a", "roi_b", "region_a", "region_b", "relation")


def frame_shapes(s, d):
    """Areas of the parts of every pair of structures on the slices of their contours."""
    own = _nodes(s, d)
    slices = written(structures.region_slices(own)).where("has_region and not is_interpolated and not is_boundary")
    keys = ["set_id", "roi_a", "roi_b", "zk"]
    pairs = shapes.slice_pairs(slices, structures.pairs_of(structures.volumes(own)))
    out = shapes.measured(spread(pairs, "set_id", "roi_a", "roi_b"), keys)
    return out.select("set_id", "roi_a", "roi_b", F.expr("zk div 10000").alias("z"), "part", F.round("area").cast("long").alias("area"))


def generated_scenes(s, d):
    """Contours, total area and range of a volume generated for every part: a cuboid, a
    standing or a lying cylinder, or a prism, in sizes of the part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    r, h = (1 + size % 4).cast("double"), (1 + k % 5).cast("double")
    own = B.read(s, d, "part").select("p_partkey", (k % 4).cast("int").alias("k"), r.alias("r"), F.when(k % 4 == 2, 2 * r).otherwise(h).alias("h"))
    # Parts of one kind and size have one volume: each is generated once.
    size = ["k", "r", "h"]
    at = own.select(*size).distinct().select(*size, F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("h") / 0.5).cast("int")), lambda i: F.round(-F.col("h") / 2 + i * 0.5, 4))).alias("z"))
    chord = F.greatest(F.round(2 * F.sqrt(F.greatest(F.col("r") * F.col("r") - F.col("z") * F.col("z"), F.lit(0.0))), 2), F.lit(0.01))
    prism = F.array(*[F.struct((F.lit(x) * F.col("r")).alias("x"), (F.lit(y) * F.col("r")).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 3.0))])
    ring = F.when(F.col("k") == 0, G.box(F.col("r"), 2 * F.col("r"))).when(F.col("k") == 1, G.circle(F.col("r"))).when(F.col("k") == 2, G.box(F.lit(6.0), chord)).otherwise(prism)
    kind = F.element_at(F.array(*map(F.lit, ("cuboid", "cylinder", "bar", "prism"))), F.col("k") + 1)
    area = F.round(F.sum(scalars.ring_area(ring)), 3).alias("area")
    made = at.groupBy(*size, kind.alias("kind")).agg(F.count("*").alias("n_contours"), area, F.min("z").alias("lo"), F.max("z").alias("hi"))
    return own.join(made, size).select("p_partkey", "kind", "n_contours", "area", "lo", "hi")


def definition_table(s, d):
    """Definitions, and how many pairs of the boxes have each relation, in both directions."""
    rel = B.pair_relations(B.solid_boxes(B.read(s, d, "supplier")))
    back = D.classify(bits.transpose(F.col("bits")))
    n = rel.select(F.explode(F.array("relation", back)).alias("relation_type")).groupBy("relation_type").agg(F.count("*").alias("n"))
    defs = D.relation_defs(s).select("relation_type", "label", F.col("symmetric").alias("is_symmetric"), F.col("transitive").alias("is_transitive"), "complement", "mask", "value")
    return defs.join(n, "relation_type", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def name_components(s, d):
    """Names put together of parts, taken apart again by the grammars, and their order."""
    k = F.col("p_partkey")
    pick = lambda by, *of: F.element_at(F.array(*map(F.lit, of)), (by % len(of) + 1).cast("int"))
    div = lambda n: F.expr(f"p_partkey div {n}")
    target = F.concat(pick(div(3), "", "eval ", "opt "), pick(div(5), "GTV", "CTV", "ITV", "PTV"), pick(div(7), "", "n"), F.lit(" "), (40 + k % 30).cast("string"), pick(div(11), "", "+5mm", "-3 mm", "+1.5cm"), pick(div(13), "", " L", " R"))
    organ = F.concat(pick(div(3), "", "opt ", "PRV 5mm "), pick(div(5), "Parotid", "lung", "Kidney", "FEMUR", "Spinal Cord"), pick(div(7), "", " L", " R", "_B"), pick(div(11), "", " 2", " 12"))
    other = F.concat(F.substring_index("p_name", " ", 1), pick(div(3), " Ring", " fiducials", "_Wire", " Air", ""))
    named = B.read(s, d, "part").select(k.alias("roi"), F.when(k % 3 == 0, target).when(k % 3 == 1, organ).otherwise(other).alias("name"))
    out = grammar.components(named).withColumn("o", grammar.order())
    t, o = F.col("target"), F.col("organ")
    return out.select("roi", "name", "kind", F.coalesce(t["TargetType"], o["BaseOAR"], "other_type").alias("type"), F.coalesce(t["Mod"], o["Opt"]).alias("mod"), "level", "cgy", "expansion_sign", "expansion_mm", "side", o["PRV_Size"].alias("prv"), o["Occurrence"].alias("occurrence"), F.col("o.group").alias("group"), F.col("o.first").alias("first"))


QUERIES = {f.__name__: f for f in (name_components, tolerance_relations, generated_scenes, definition_table, structure_shapes, interpolated_boxes, frame_contours, frame_volumes, frame_relations, frame_regions, frame_shapes)}
