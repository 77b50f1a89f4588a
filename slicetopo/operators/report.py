"""Data products: symbols, per-slice records, payloads, diagram nodes and edges, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming, scalars
from ..plans import definitions as D
from .boxes import matrix_long
from .labels import display_mode

FLIP = {"⊂": "⊃", "⊏": "⊐"}


def symbols(cells: DataFrame) -> DataFrame:
    """``cells`` with label and symbol: reversed arrows are turned, logical relations stand in
    brackets, missing ones are unknown."""
    symbol = D.lookup(F.col("relation"), "symbol")
    turned = symbol
    for a, b in FLIP.items():
        turned = F.when(D.lookup(F.col("relation"), "reversed_arrow") & (symbol == a), F.lit(b)).otherwise(turned)
    shown = F.coalesce(F.nullif(turned, F.lit("")), F.lit("?"))
    label = F.coalesce(F.nullif(D.lookup(F.col("relation"), "label"), F.lit("")), F.lit("Unknown"))
    logical = F.col("is_logical") if "is_logical" in cells.columns else F.lit(False)
    wrap = lambda c: F.when(logical, F.concat(F.lit("["), c, F.lit("]"))).otherwise(c)
    return cells.withColumns({"label": wrap(label), "symbol": wrap(shown)})


def resolve(override, identical, relation):
    """A relation's type: what a user set, then equality, then what was found."""
    return F.coalesce(override, F.when(identical, F.lit("EQUAL")), relation, F.lit("UNKNOWN"))


def slice_records(slice_relations: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, records): a map from slice labels to label, symbol,
    is_interpolated and has_boundary; the last two are false where they are not given."""
    out = symbols(slice_relations.withColumns({c: F.lit(False) for c in ("is_interpolated", "has_boundary") if c not in slice_relations.columns}))
    entry = F.struct(scalars.slice_label(F.col("z").cast("double")).alias("key"), F.struct("label", "symbol", "is_interpolated", "has_boundary").alias("value"))
    return out.groupBy("set_id", "roi_a", "roi_b").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("records"))


def contour_slice_records(met: DataFrame) -> DataFrame:
    """Records of the slices that :func:`structures.slice_relations` gave."""
    named = met.where("bits <> 0").select("set_id", "roi_a", "roi_b", (F.col("zk") / 10000).alias("z"), D.classify(F.col("bits")).alias("relation"), "is_interpolated", "has_boundary")
    return slice_records(named)


def payload(relations: DataFrame, structures: DataFrame, slices: DataFrame | None = None, records: DataFrame | None = None, mode: str = "show", visible: list[int] | None = None, use_symbols: bool = False, unit: str = "cm") -> DataFrame:
    """(set_id, payload): what a client shows of a set, as JSON.

    ``relations`` may have is_logical and intermediates, ``structures`` name, dicom_type,
    code_meaning, color (three numbers), volume, num_regions and slice_range; what is missing
    has empty values. ``slices``: (set_id, roi, z, is_interpolated), ``records``: what
    :func:`slice_records` gave. Cells that the mode hides are null; faded ones are listed by
    their places in the matrix."""
    own = structures
    for name, empty in (("name", F.col("roi").cast("string")), ("dicom_type", F.lit("")), ("code_meaning", F.lit("")), ("color", F.lit(None).cast("array<int>")), ("volume", F.lit(0.0)), ("num_regions", F.lit(0)), ("slice_range", F.lit(""))):
        if name not in own.columns:
            own = own.withColumn(name, empty)
    shown = symbols(display_mode(matrix_long(relations, structures), visible, mode))
    cell = F.when(F.col("shown"), F.col("symbol" if use_symbols else "label"))
    row = F.map_from_entries(F.collect_list(F.struct("col_roi", F.struct(cell.alias("v"), (F.col("shown") & F.col("faded")).alias("f")))))
    rows = shown.groupBy("set_id", "row_roi").agg(row.alias("c"))
    matrix = rows.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("row_roi", "c"))).alias("m"))
    # Every structure has a row and a column; pairs without a relation are null.
    rois = F.transform("s", lambda x: x["roi"])
    at = lambda i, j: F.try_element_at(F.try_element_at(F.col("m"), i), j)
    data = F.transform(rois, lambda r: F.transform(rois, lambda c: at(r, c)["v"]))
    marks = F.flatten(F.transform(rois, lambda r, i: F.transform(rois, lambda c, j: F.struct(F.concat_ws("_", i, j).alias("key"), F.coalesce(at(r, c)["f"], F.lit(False)).alias("value")))))
    faded = F.filter(marks, lambda e: e["value"])
    named = own.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("roi", "name", "dicom_type", "code_meaning", "color", "volume", "num_regions", "slice_range"))).alias("s"))
    by_roi = lambda field: F.map_from_entries(F.transform(F.filter("s", lambda x: x[field].isNotNull()), lambda x: F.struct(x["roi"].cast("string"), x[field])))
    got = matrix.join(named, "set_id")
    fields = [rois.alias("rows"), rois.alias("columns"), data.alias("data"), F.transform("s", lambda x: x["name"]).alias("row_names"), F.transform("s", lambda x: x["name"]).alias("col_names"), by_roi("color").alias("colors"), by_roi("dicom_type").alias("dicom_types"), by_roi("code_meaning").alias("code_meanings"), by_roi("volume").alias("volumes"), by_roi("num_regions").alias("num_regions"), by_roi("slice_range").alias("slice_ranges")]
    if slices is not None:
        per = slices.groupBy("set_id", "roi").agg(*[F.array_sort(F.collect_set(F.when(c, F.col("z")))).alias(n) for n, c in (("a", F.lit(True)), ("o", ~F.col("is_interpolated")), ("i", F.col("is_interpolated")))])
        sets = per.groupBy("set_id").agg(F.collect_list(F.struct("roi", "a", "o", "i")).alias("z"))
        got = got.join(sets, "set_id", "left")
        each = lambda part: F.map_from_entries(F.transform(F.array_sort("z"), lambda x: F.struct(x["roi"].cast("string"), x[part])))
        pool = lambda part: F.array_sort(F.array_distinct(F.flatten(F.transform("z", lambda x: x[part]))))
        fields += [pool("a").alias("slice_indices"), pool("o").alias("slice_indices_original"), each("a").alias("structure_slices"), each("o").alias("structure_slices_original"), each("i").alias("structure_slices_interpolated")]
    if records is not None:
        pair = F.concat_ws("|", F.least("roi_a", "roi_b"), F.greatest("roi_a", "roi_b"))
        got = got.join(records.groupBy("set_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(pair.alias("pair"), F.map_entries("records").alias("r"))))).alias("slice_relationships")), "set_id", "left")
        fields.append(F.transform_values("slice_relationships", lambda _, v: F.map_from_entries(v)).alias("slice_relationships"))
    if mode == "faded":
        fields.append(F.map_from_entries(faded).alias("faded_relationships"))
    return got.select("set_id", F.to_json(F.struct(*fields, F.lit(unit).alias("unit"))).alias("payload"))


def diagram_edges(relations: DataFrame, show_disjoint: bool = False, show_unknown: bool = False, mode: str = "show", visible: list[int] | None = None, order: DataFrame | None = None) -> DataFrame:
    """Edges of a diagram: (set_id, roi_a, roi_b, relation, symmetric, label, is_logical, faded,
    weight, layout_candidate), symmetric relations once.

    Logical edges are shown as the mode says. Equal structures share their edges: of edges of
    one relation and direction from an outside structure to them, those of the first (by
    ``order``, else the smallest) stay, the others count as logical, if the first has one. So
    they go in the modes hide and limited, and fade in faded."""
    r = relations
    if visible:
        r = r.where(F.col("roi_a").isin(visible) & F.col("roi_b").isin(visible))
    if "is_logical" not in r.columns:
        r = r.withColumn("is_logical", F.lit(False))
    if "intermediates" not in r.columns:
        r = r.withColumn("intermediates", F.array().cast("array<long>"))
    r = display_mode(r, visible, mode).where("shown")
    if not show_disjoint:
        r = r.where("relation <> 'DISJOINT'")
    if not show_unknown:
        r = r.where("relation <> 'UNKNOWN'")
    lo, hi = F.least("roi_a", "roi_b"), F.greatest("roi_a", "roi_b")
    symmetric = D.lookup(F.col("relation"), "symmetric")
    once = F.row_number().over(Window.partitionBy("set_id", lo, hi, "relation").orderBy("roi_a"))
    r = r.withColumn("symmetric", symmetric).withColumn("_n", once).where(~F.col("symmetric") | (F.col("_n") == 1)).drop("_n")
    # The first of each group of equal structures; all of a group are linked with each other
    # or with the first, so two steps reach it.
    e = r.where("relation = 'EQUAL'").select("set_id", F.col("roi_a").alias("roi"), F.col("roi_b").alias("other"))
    e = e.unionByName(e.select("set_id", F.col("other").alias("roi"), F.col("roi").alias("other")))
    place = order.select("set_id", F.col("roi").alias("other"), F.col("place").cast("long").alias("p")) if order is not None else e.select("set_id", "other", F.col("other").cast("long").alias("p")).distinct()
    own = e.select("set_id", "roi", F.col("roi").alias("other")).unionByName(e).distinct().join(place, ["set_id", "other"])
    first = own.groupBy("set_id", "roi").agg(F.min(F.struct("p", "other")).alias("f"))
    again = own.select("set_id", "roi", "other").join(first.select("set_id", F.col("roi").alias("other"), "f"), ["set_id", "other"])
    head = again.groupBy("set_id", "roi").agg(F.min("f").alias("f")).select("set_id", "roi", F.col("f.other").alias("head"))
    side = lambda x: head.select("set_id", F.col("roi").alias(f"roi_{x}"), F.col("head").alias(f"head_{x}"))
    r = r.join(side("a"), ["set_id", "roi_a"], "left").join(side("b"), ["set_id", "roi_b"], "left")
    inside = F.coalesce(F.col("head_a") == F.col("head_b"), F.lit(False))
    for mine, other in (("a", "b"), ("b", "a")):
        group = Window.partitionBy("set_id", f"head_{mine}", f"roi_{other}", "relation", F.when(F.col("symmetric"), "s").otherwise(mine))
        has_first = F.max(F.when(F.col(f"roi_{mine}") == F.col(f"head_{mine}"), 1).otherwise(0)).over(group) == 1
        r = r.withColumn(f"peer_{mine}", F.col(f"head_{mine}").isNotNull() & ~inside & (F.col("relation") != "EQUAL") & has_first & (F.col(f"roi_{mine}") != F.col(f"head_{mine}")))
    peer = F.col("peer_a") | F.col("peer_b")
    r = r.withColumn("is_logical", F.coalesce("is_logical", F.lit(False)) | peer).withColumn("faded", F.col("faded") | (peer if mode == "faded" else F.lit(False)))
    if mode in ("hide", "limited"):
        r = r.where(~peer)
    label = D.lookup(F.col("relation"), "label")
    return r.select("set_id", "roi_a", "roi_b", "relation", "symmetric", F.when(F.col("is_logical"), F.concat(F.lit("["), label, F.lit("]"))).otherwise(label).alias("label"), "is_logical", "faded", F.when(F.col("relation") == "OVERLAPS", 0.5).otherwise(1.0).alias("weight"), ((F.col("relation") != "DISJOINT") & ~F.col("faded")).alias("layout_candidate"))


def diagram_nodes(rois: DataFrame) -> DataFrame:
    """Nodes: shape by type, colour, tooltip, side, variant and dose groups from (roi, name,
    roi_type) and, if given, color (three numbers), volume and num_regions."""
    shape = F.when(F.col("roi_type").isin("PTV", "CTV", "GTV"), "diamond").when(F.col("roi_type") == "EXTERNAL", "box").otherwise("ellipse")
    n = F.col("name")
    grey = F.lit("#c8c8c8")
    color = F.when(F.size("color") == 3, scalars.rgb_to_hex(*[F.col("color")[i] for i in range(3)])).otherwise(grey) if "color" in rois.columns else grey
    lines = [F.concat(n, F.lit(" (ROI "), F.col("roi").cast("string"), F.lit(")")), F.concat(F.lit("Type: "), F.coalesce("roi_type", F.lit("NONE")))]
    if "volume" in rois.columns:
        lines.append(F.concat(F.lit("Volume: "), F.format_string("%.2f", F.col("volume").cast("double")), F.lit(" cm³")))
    if "num_regions" in rois.columns:
        lines.append(F.concat(F.lit("Regions: "), F.col("num_regions").cast("string")))
    return rois.select("roi", "name", shape.alias("shape"), color.alias("color"), F.concat_ws("\n", *lines).alias("title"), naming.side_tag(n).alias("side"), naming.variant_group(n).alias("variant"), naming.dose_group(n).alias("dose"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def extents(contours: DataFrame, rois: DataFrame) -> DataFrame:
    """(set_id, roi, name, dx, dy): the box around all of a structure's contours."""
    points = contours.select("set_id", "roi", F.explode("points").alias("p"))
    box = points.groupBy("set_id", "roi").agg((F.max("p.x") - F.min("p.x")).alias("dx"), (F.max("p.y") - F.min("p.y")).alias("dy"))
    return box.join(rois.select("set_id", "roi", "name"), ["set_id", "roi"], "left").select("set_id", "roi", "name", "dx", "dy")


def resolution(extents: DataFrame, pixels: int = 512, default_cm: float = 50.0) -> DataFrame:
    """(set_id, resolution): the body's extent, or the largest structure's, over two times the
    pixels, rounded up to one digit. ``extents``: (set_id, name, dx, dy)."""
    is_body = F.upper("name").isin("BODY", "EXTERNAL", "PATIENT", "SKIN")
    best = extents.groupBy("set_id").agg(F.max(F.when(is_body, F.greatest("dx", "dy"))).alias("body"), F.max_by(F.greatest("dx", "dy"), F.struct(F.col("dx") * F.col("dy"), F.greatest("dx", "dy"))).alias("largest"))
    return best.select("set_id", scalars.round_one_up(F.coalesce("body", "largest", F.lit(default_cm)) / (2 * pixels)).alias("resolution"))
