"""The registered queries, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import naming, scalars
from .operators import boxes as B
from .operators import filters, labels, logical, metrics, places, report, slices, structures
from . import catalog_shapes, oracles_shapes
from . import oracles as plain
from .plans import definitions as D
from .session import written
from .sources import generators as G

# ---- queries ----------------------------------------------------------------

b1 = lambda s, d: B.slice_boxes(B.read(s, d, "lineitem"))
b2 = lambda s, d: B.solid_boxes(B.read(s, d, "supplier"))
pairs = lambda s, d: B.pair_relations(b2(s, d))
areas = lambda s, d: b1(s, d).select("set_id", "roi", "z", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double").alias("area"))

#: Years as slices of customers, with slices missing.
years = lambda s, d: B.read(s, d, "orders").select(F.floor(F.col("o_custkey") / 40).cast("long").alias("set_id"), (F.col("o_custkey") % 40).cast("long").alias("roi"), F.year("o_orderdate").cast("long").alias("z")).distinct()

RULES = [
    filters.Rule("promo", "include", "DICOM Type", "suffix", "romo"),
    filters.Rule("standard", "exclude", "DICOM Type", "prefix", "standard"),
    filters.Rule("small", "hide", "DICOM Type", "regex", "small|MEDIUM"),
    filters.Rule("shown", "display", "Brand", "exact", "BRAND#12", also=filters.Rule("", "", "DICOM Type", "regex", "large")),
    filters.Rule("off", "include", "DICOM Type", "regex", ".*", enabled=False),
]


def _parts(s, d):
    return B.read(s, d, "part").select(F.col("p_partkey").alias("roi"), F.col("p_name").alias("Structure ID"), F.col("p_type").alias("DICOM Type"), F.col("p_brand").alias("Brand"), "p_size")


def filter_rule_report(s, d):
    out = filters.report(_parts(s, d), RULES)
    return out.select("roi", F.col("SelectedByDefault").alias("selected"), F.col("DisplayedByDefault").alias("displayed"), F.array_join(F.transform("MatchedRules", lambda m: m["id"]), ",").alias("matched"), F.col("FinalMatch.id").alias("final"), F.col("FilterReason").alias("reason"))


def _names(s, d):
    """Names in the manner of structures, from parts."""
    k = F.col("p_partkey")
    p = B.read(s, d, "part")
    family = F.element_at(F.array(*map(F.lit, ("PTV", "gtv", "ITV", "CTV"))), (k % 4 + 1).cast("int"))
    target = F.concat(family, F.lit(" "), (F.lit(40) + k % 30).cast("string"), F.element_at(F.array(*map(F.lit, ("", "a", "b"))), (k % 3 + 1).cast("int")))
    word = F.substring_index("p_name", " ", 1)
    organ = F.concat(word, F.element_at(F.array(*map(F.lit, (" L", " R", " B", "", "_PRV05"))), (k % 5 + 1).cast("int")))
    opt = F.concat(F.element_at(F.array(*map(F.lit, ("opt ", "eval "))), (k % 2 + 1).cast("int")), word, F.element_at(F.array(*map(F.lit, (" a", " b", ""))), (k % 3 + 1).cast("int")))
    return p.select(k.alias("roi"), F.when(k % 3 == 0, target).when(k % 3 == 1, organ).otherwise(opt).alias("name"))


def name_groups(s, d):
    n = F.col("name")
    return _names(s, d).select("roi", "name", naming.side_tag(n).alias("side"), naming.variant_group(n).alias("variant"), naming.dose_group(n).alias("dose"))


def name_checks(s, d):
    named = _names(s, d)
    times = named.groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("times"))
    j = named.join(times, F.lower("name") == F.col("low"))
    return j.select("roi", *[c.alias(k) for k, c in naming.checks(F.col("name"), F.col("times")).items()])


def custom_sort_index(s, d):
    order = ["Brand#17", "Brand#12", "Brand#2"]
    from pyspark.sql import Window

    p = B.read(s, d, "part")
    first = naming.sort_rank(F.col("p_brand"), order)
    # Distinct combinations are ranked, so the window is over few rows; rows join them.
    combos = p.groupBy(first.alias("r"), "p_type", "p_size").agg(F.count("*").alias("_n")).withColumn("sort_index", F.dense_rank().over(Window.partitionBy("r").orderBy("p_type", F.desc("p_size"))).cast("long"))
    return p.select("p_partkey", first.alias("r"), "p_type", "p_size").join(combos, ["r", "p_type", "p_size"]).select("p_partkey", F.col("r").cast("int").alias("brand_rank"), "sort_index")


def rounding(s, d):
    x, q = F.col("l_extendedprice"), F.col("l_quantity").cast("double")
    return B.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.round_one_up(F.floor(x)).cast("long").alias("one_up"), F.round(scalars.floor_to_grid(x, 0.5) * 2).cast("long").alias("half_steps"), F.round(scalars.round_value(F.floor(x).cast("double"), 10.0)).cast("long").alias("tens"), F.round(scalars.round_value(q * 0.125, 0.01) * 1000).cast("long").alias("fine"), F.round(scalars.round_value(q * 0.3, 0.5) * 10).cast("long").alias("halves"), scalars.slice_key(F.col("l_quantity")).alias("zk"), scalars.slice_label(F.col("l_quantity").cast("double")).alias("label"))


def unit_conversions(s, d):
    q = F.col("l_quantity").cast("double")
    unit = F.when(F.col("l_linenumber") % 2 == 0, "cm").otherwise("mm")
    dose = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "Gy").when(F.col("l_linenumber") % 3 == 1, "00").otherwise(" dose"))
    return B.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.to_millimetres(q, unit).alias("mm"), scalars.to_centigray(q * 3, F.lit("Gy")).alias("cgy"), naming.dose_to_cgy(dose).alias("dose"))


def slice_label_counts(s, d):
    """Relations of slices, and how the kinds are spread over slices."""
    return B.slice_relations(b1(s, d)).groupBy("z").pivot("relation", [x.name for x in D.DEFINITIONS]).agg(F.count(F.lit(1))).fillna(0)


def slice_label_counts_all(s, d):
    """Relations of slices of every kind, and pairs, by slice."""
    return B.slice_relations(b1(s, d)).groupBy("z").agg(F.count("*").alias("pairs"), *[F.count_if(F.col("relation") == x.name).alias(x.name) for x in D.DEFINITIONS])


def transpose_check(s, d):
    from .functions import bits

    r = pairs(s, d)
    return r.select("set_id", "roi_a", "roi_b", D.classify(bits.transpose(F.col("bits"))).alias("reverse"), D.lookup(F.col("relation"), "complement").alias("complement"), bits.to_text(F.col("bits")).alias("text"))


def _rings(boxes):
    """Boxes as contours of structures, with string set names."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = F.array(corner("x1", "y1"), corner("x1", "y0"), corner("x0", "y0"), corner("x0", "y1"))
    return boxes.select(F.col("set_id").cast("string").alias("set_id"), F.col("roi").cast("int").alias("roi"), F.col("z").cast("double").alias("z"), points.alias("points")).select(*[c.split(" ")[0] for c in G.CONTOURS.replace("<struct<x:double,y:double>>", "").split(", ")])


def kernel_relations(s, d):
    """The general kernel on every pair of boxes of a slice: relation and common area."""
    import numpy as np

    from .operators import kernel as K
    from .session import ship

    ship(s)
    box = lambda r: [("+", np.array([(r[0], r[2]), (r[1], r[2]), (r[1], r[3]), (r[0], r[3])]))]

    def run(batches):
        for pdf in batches:
            met = [(box(r[:4]), box(r[4:])) for r in pdf[B.KIND].to_numpy(dtype=float)]
            yield pdf.assign(bits=K.relate27_many(met).astype(np.int32), common=np.round(K.common_areas(met)).astype(np.int64))

    kinds = ", ".join(f"{c} long" for c in B.KIND)
    got = B.by_kind(B.moved_pairs(b1(s, d)), lambda k: k.mapInPandas(run, f"{kinds}, bits int, common long"))
    return got.select("set_id", "roi_a", "roi_b", "z", D.classify(F.col("bits")).alias("relation"), "common")


def _solid_contours(s, d):
    on = b2(s, d).withColumn("z", F.explode(F.sequence("z0", "z1")))
    return _rings(on)


def ring_measures(s, d):
    """Area, centroid and bounds of every ring, by shoelace expressions."""
    r = _rings(b1(s, d))
    c, o = scalars.ring_centroid(F.col("points")), scalars.ring_bounds(F.col("points"))
    return r.select("set_id", "roi", F.col("z").cast("long").alias("z"), F.round(scalars.ring_area(F.col("points"))).cast("long").alias("area"), F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"), o["x0"].alias("x0"), o["y1"].alias("y1"))


def _nodes(s, d):
    """Contours and caps of the solid boxes, written once for all that follows."""
    return written(structures.nodes(_solid_contours(s, d)))


def structure_contours(s, d):
    return structures.contour_report(_nodes(s, d))


def structure_volumes(s, d):
    return structures.volumes(_nodes(s, d))


def structure_table(s, d):
    rois = b2(s, d).select(F.col("set_id").cast("string").alias("set_id"), F.col("roi").cast("int").alias("roi"), F.concat(F.lit("structure "), "roi").alias("name"))
    return structures.summary(_nodes(s, d), rois)


def structure_extents(s, d):
    """Resolution of each set, from the extents of its contours."""
    contours = _solid_contours(s, d)
    rois = contours.select("set_id", "roi", F.concat(F.lit("structure "), "roi").alias("name")).distinct()
    out = report.resolution(report.extents(contours, rois))
    return out.select("set_id", F.round("resolution", 9).alias("resolution"))


def _slices(s, d):
    """Region slices of the solid boxes, written once, and the order of their structures."""
    own = _nodes(s, d)
    return written(structures.region_slices(own)), structures.volumes(own)


def structure_relations(s, d):
    """The whole way from contours: caps, in-fill, region slices, pairs, merged bits."""
    return structures.relations(*_slices(s, d))


def structure_slice_records(s, d):
    """Relations of every pair on every original slice, with flags, from the records."""
    records = report.contour_slice_records(structures.slice_relations(*_slices(s, d)).where("not has_boundary and not is_interpolated"))
    return records.select("set_id", "roi_a", "roi_b", F.explode("records").alias("slice", "r")).select("set_id", "roi_a", "roi_b", "slice", "r.*")


def _metric(s, d, name):
    own, order = _slices(s, d)
    return metrics.calculate(name, own, written(structures.relations(own, order)))


def structure_margins(s, d):
    return _metric(s, d, "minimum_margins")


def structure_distances(s, d):
    return _metric(s, d, "minimum_distance").select("set_id", "roi_a", "roi_b", "minimum_distance")


def structure_overlaps(s, d):
    return _metric(s, d, "volume_overlap").select("set_id", "roi_a", "roi_b", F.round("dice", 6).alias("dice"), F.round("overlap_ratio", 6).alias("overlap_ratio"), F.round("common_area").cast("long").alias("common_area"))


def region_relations(s, d):
    own = _nodes(s, d)
    return structures.region_relations(structures.regions(own), structures.volumes(own))


def logical_flags(s, d):
    out = logical.flags(pairs(s, d))
    return out.withColumn("intermediates", F.concat_ws(",", F.col("intermediates").cast("array<string>")))


def relation_matches(s, d):
    """How many definitions hold for every pair, and from the other side: one at most."""
    from .functions import bits
    from .plans import soundness

    there, back = (soundness.matches(x) for x in (F.col("bits"), bits.transpose(F.col("bits"))))
    r = pairs(s, d)
    return r.select("set_id", "roi_a", "roi_b", F.size(there).alias("n_matches"), F.array_join(there, ",").alias("names"), F.size(back).alias("n_reverse"), F.array_join(back, ",").alias("reverse_names"))


def logical_contains(s, d):
    return B.logical(pairs(s, d)).withColumn("intermediates", F.concat_ws(",", F.col("intermediates").cast("array<string>")))


def logical_limited_mode(s, d):
    out = labels.display_mode(B.logical(pairs(s, d)), list(range(1, 13)), "limited")
    return out.withColumn("intermediates", F.array_join(F.transform(F.array_sort("intermediates"), lambda x: x.cast("string")), ","))


def _box_regions(s, d):
    """Relations of the slice boxes' structures, and of each pair of their regions."""
    per = B.region_pair_relations(b1(s, d))
    whole = per.groupBy("set_id", "roi_a", "roi_b").agg(F.bit_or("bits").alias("bits"))
    return whole.withColumn("relation", D.classify(F.col("bits"))), per


def region_label(s, d):
    return labels.display_label(*_box_regions(s, d))


def relation_description(s, d):
    out = labels.describe(*_box_regions(s, d))
    text = F.array_join(F.transform("summary", lambda x: F.concat(x["label"], F.lit(":"), x["count"].cast("string"))), "; ")
    return out.select("set_id", "roi_a", "roi_b", "consolidated_label", "consolidated_type", "has_multiple_regions", F.size("per_region").cast("long").alias("n_region_pairs"), text.alias("summary"))


def relation_symbols(s, d):
    cells = report.symbols(B.matrix_long(pairs(s, d), b2(s, d)))
    return cells.select("set_id", "row_roi", "col_roi", "label", "symbol")


def _payload(s, d):
    boxes, rel = b2(s, d), pairs(s, d)
    own = boxes.withColumns({"name": F.concat(F.lit("structure "), "roi"), "num_regions": F.lit(1), "slice_range": F.concat_ws(" to ", "z0", "z1")})
    on = boxes.select("set_id", "roi", F.explode(F.sequence("z0", "z1")).alias("z"), F.lit(False).alias("is_interpolated"))
    return report.payload(rel, own, on)


def set_payload(s, d):
    """What a client shows of each set, with flags of logical relations, faded."""
    rel = logical.flags(pairs(s, d)).withColumn("set_id", F.col("set_id").cast("long"))
    return report.payload(rel, b2(s, d), mode="faded")


def payload_cells(s, d):
    """The matrix as a client reads it from the payload."""
    read = F.from_json("payload", "rows array<long>, columns array<long>, data array<array<string>>")
    rows = _payload(s, d).select("set_id", read.alias("p")).select("set_id", "p.columns", F.explode(F.arrays_zip("p.rows", "p.data")).alias("r"))
    cells = rows.select("set_id", F.col("r.rows").alias("row_roi"), F.explode(F.arrays_zip("columns", "r.data")).alias("c"))
    return cells.select("set_id", "row_roi", F.col("c.columns").alias("col_roi"), F.col("c.data").alias("label"))


def diagram_edges(s, d):
    return report.diagram_edges(pairs(s, d))


def swapped_text(s, d):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "A is in B").when(k % 4 == 1, "A and B").when(k % 4 == 2, "B and A touch B").otherwise("AB, a and A")
    file = F.when(k % 3 == 0, "upload_upload_plan.dcm").when(k % 3 == 1, "0123456789abcdef0123456789abcdef_x.dcm").otherwise("upload_")
    turned = naming.swap_ab(text)
    return B.read(s, d, "part").select("p_partkey", turned.alias("given"), naming.swap_ab(turned).alias("swapped"), naming.strip_upload_prefix(file).alias("file"))


def name_grammar(s, d):
    parts = naming.parse_name(F.col("name"), "organ")
    return _names(s, d).select("roi", *[c.alias(k) for k, c in parts.items()])


def name_grammar_all(s, d):
    """Every name by every grammar; ``grammar``: the first that takes the name, target names
    before margins and organs."""
    n = F.col("name")
    parts = {g: naming.parse_name(n, g) for g in ("target", "margin", "organ")}
    takes = {"target": parts["target"]["family"], "margin": parts["margin"]["size"], "organ": parts["organ"]["organ"]}
    chosen = F.coalesce(*[F.when(c.isNotNull(), F.lit(g)) for g, c in takes.items()])
    return _names(s, d).select("roi", "name", chosen.alias("grammar"), *[c.alias(f"{g}_{k}") for g, cs in parts.items() for k, c in cs.items()])


def name_order(s, d):
    """Names in the order of lists: the kind, and the place among distinct ones of a kind."""
    named = _names(s, d).withColumn("k", naming.order_of(F.col("name"))).withColumn("kind", F.col("k.kind"))
    found = places.dense_places(named, "kind", "k").drop("kind")
    return named.join(found, "k").select("roi", "name", "kind", "place")


def streamed_relations(s, d):
    from .streaming.ingest import relations_by_stream

    return relations_by_stream(s, d, "supplier.parquet")


QUERIES = {
    "box_slice_relations": lambda s, d: B.slice_relations(b1(s, d)),
    "box_pair_relations": lambda s, d: pairs(s, d),
    "relation_histogram_ranked": lambda s, d: B.histogram(pairs(s, d)),
    "relation_transpose_check": transpose_check,
    "relation_matrix_long": lambda s, d: B.matrix_long(pairs(s, d), b2(s, d)).select("set_id", "row_roi", "col_roi", "relation"),
    "relation_cumulative": lambda s, d: B.cumulative(B.slice_relations(b1(s, d))),
    "relation_slice_pivot": slice_label_counts,
    "logical_contains": logical_contains,
    "logical_limited_mode": logical_limited_mode,
    "equal_components": lambda s, d: B.equal_components(pairs(s, d), b2(s, d)),
    "region_label": region_label,
    "relation_description": relation_description,
    "box_metrics": lambda s, d: B.box_metrics(b2(s, d), pairs(s, d)),
    "volume_rank": lambda s, d: B.volume_rank(b2(s, d)),
    "region_components": lambda s, d: B.components_of_structures(b1(s, d)),
    "nearest_slice": lambda s, d: B.nearest_slice(b1(s, d)),
    "slice_sequence": lambda s, d: slices.sequence(b1(s, d), "set_id", "roi"),
    "slice_spacing": lambda s, d: slices.spacing(b1(s, d), "set_id", "roi"),
    "missing_slices": lambda s, d: slices.missing(years(s, d), years(s, d)),
    "slice_gaps": lambda s, d: slices.has_gaps(b1(s, d)),
    "trapezoid_volume": lambda s, d: slices.trapezoid_volume(areas(s, d), "set_id", "roi"),
    "structure_summary": lambda s, d: slices.summary(areas(s, d), "set_id", "roi"),
    "filter_rule_report": filter_rule_report,
    "filter_preview": lambda s, d: filters.preview(filters.report(_parts(s, d), RULES)),
    "filter_excluded": lambda s, d: filters.without_excluded(_parts(s, d), filters.report(_parts(s, d), RULES), "roi").select("roi"),
    "include_exclude_names": lambda s, d: B.read(s, d, "part").where(filters.name_kept(F.col("p_name"), ["^[a-m]", "(bad"], ["green", "z$"])).select("p_partkey", "p_name"),
    "name_groups": name_groups,
    "name_checks": name_checks,
    "custom_sort_index": custom_sort_index,
    "rounding": rounding,
    "unit_conversions": unit_conversions,
    "streamed_relations": streamed_relations,
    "kernel_relations": kernel_relations,
    "ring_measures": ring_measures,
    "structure_contours": structure_contours,
    "structure_volumes": structure_volumes,
    "structure_relations": structure_relations,
    "structure_margins": structure_margins,
    "structure_distances": structure_distances,
    "structure_overlaps": structure_overlaps,
    "structure_slice_records": structure_slice_records,
    "structure_table": structure_table,
    "structure_extents": structure_extents,
    "swapped_text": swapped_text,
    "payload_cells": payload_cells,
    "region_relations": region_relations,
    "logical_flags": logical_flags,
    "relation_matches": relation_matches,
    "relation_symbols": relation_symbols,
    "set_payload": set_payload,
    "diagram_edges": diagram_edges,
    "name_grammar": name_grammar,
    "name_grammar_all": name_grammar_all,
    "name_order": name_order,
    "relation_slice_pivot_all": slice_label_counts_all,
}
QUERIES |= catalog_shapes.QUERIES
ORACLES = plain.ORACLES | oracles_shapes.ORACLES

__all__ = ["ORACLES", "QUERIES"]
