"""From contours to region slices, and from these to relations and metrics.

A structure (one ROI of a set) is small: its contours are put together at once, over the set's
slice sequence, which travels as an array column, with many structures in a call. What comes out,
contours and caps with their links, is a table (:func:`nodes`) from which all else is made:
volumes, reports, regions, and the region slices. What grows with the corpus, the number of
sets, structures and pairs, is spread by Spark: contours are shuffled once by structure,
region slices once by set and slice, where all pairs of a slice are related in one call that
reads each structure once; the bits of slices merge with a bitwise or that is combined
before the shuffle. Functions take contours or the table that :func:`nodes` made of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as bitcols
from ..plans import definitions as D
from . import kernel as K
from .groups import arrow_schema, in_groups, names_of, repeated, runs
from .interpolation import half_way
from .known import Known

Z_STEP = 0.01
#: What a worker keeps of structures, of shapes on a slice and of their pairs.
_BUILT, _CUT, _REGIONS, _SHAPES, _LABELLED = (Known(n) for n in (4096, 2048, 2048, 8192, 8192))
_BITS, _REGION_BITS = Known(300_000), Known(300_000)
_NUMBERS = itertools.count()
#: Pairs of a slice that are put in one table.
AT_ONCE = 200_000


def key(z: float) -> int:
    return int(round(z * 10000))


def new_slice(zs: list[float], precision: float = Z_STEP) -> float:
    """The mean of slice positions, rounded to the precision; ValueError if that is not
    between them."""
    z = round(round(sum(zs) / len(zs) / precision) * precision, 6)
    if not min(zs) <= z <= max(zs):
        raise ValueError(f"{z} is not between the slices {sorted(zs)}")
    return z


def empty(slices: DataFrame) -> DataFrame:
    """``slices`` with is_empty: whether neither region nor boundary has a ring; missing parts
    are empty."""
    adds = lambda c: F.coalesce(F.col(c).contains("+"), F.lit(False))
    return slices.withColumn("is_empty", ~(adds("region_ops") | adds("boundary_ops")))


def check_contours(contours: DataFrame) -> DataFrame:
    """``contours`` with ``problem``: null, or why a ring can't be used."""
    n = F.size("points")
    bad = lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])
    problem = F.when(F.col("points").isNull() | (n < 3), "fewer than three points").when(F.col("z").isNull() | F.isnan("z"), "no slice position").when(F.exists("points", bad), "missing coordinate")
    return contours.withColumn("problem", problem)


def holes(rings: list[np.ndarray]) -> tuple[list[bool], list[int | None], list[bool]]:
    """Hole flags, containers and overlaps of one slice's rings, largest area first. A ring
    within an earlier one is a hole if that one is none; the last container decides. A ring
    that overlaps an earlier one in part is marked, and counts for nothing."""
    flags, inside_of, overlaps = [], [], []
    for i, r in enumerate(rings):
        flag, container, crossing = False, None, False
        for j in range(i):
            if overlaps[j]:
                continue
            nine = K.relate([("+", rings[j])], [("+", r)])
            if nine & K.II:
                if nine & K.EI:
                    crossing = True
                    break
                flag, container = not flags[j], j
        flags.append(flag and not crossing)
        inside_of.append(None if crossing else container)
        overlaps.append(crossing)
    return flags, inside_of, overlaps


def build(rings: pd.DataFrame, zs: list[float]) -> dict:
    """Contours, edges, regions, hole types and caps of one structure, and the rings that
    can't be used. ``rings``: z and ring; ``zs``: the set's original slices, in order."""
    at = {key(z): i for i, z in enumerate(zs)}
    nodes: list[dict] = []
    bad: list[tuple[float, np.ndarray, str]] = []
    for z, group in sorted(rings.groupby("z"), key=lambda g: g[0]):
        own = sorted((K.ring_of(r) for r in group["ring"]), key=lambda r: -abs(K.ring_area(r)))
        bad += [(z, r, "a ring that crosses itself or has no area") for r in own if not K.is_simple(r)]
        own = [r for r in own if K.is_simple(r)]
        flags, container, crossing = holes(own)
        bad += [(z, r, "a ring that overlaps another of its structure") for r, c in zip(own, crossing, strict=True) if c]
        number = np.cumsum([not c for c in crossing]) - 1 + len(nodes)
        for r, hole, inside, c in zip(own, flags, container, crossing, strict=True):
            if not c:
                nodes.append({"z": z, "ring": r, "hole": hole, "inside": None if inside is None else int(number[inside]), "cap": False, "made": False})
    by_z: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        by_z.setdefault(key(n["z"]), []).append(i)
    solid_of = [[("+", n["ring"]), *(("-", nodes[j]["ring"]) for j in by_z[key(n["z"])] if nodes[j]["hole"] and nodes[j]["inside"] == i)] for i, n in enumerate(nodes)]
    edges = []
    for i, n in enumerate(nodes):
        k = at[key(n["z"])]
        if k + 1 < len(zs):
            for j in by_z.get(key(zs[k + 1]), ()):
                if nodes[j]["hole"] == n["hole"] and K.relate(solid_of[i], solid_of[j]) & K.II:
                    edges.append((i, j))
    root = list(range(len(nodes)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in edges:
        p, q = find(i), find(j)
        root[max(p, q)] = min(p, q)
    # Hole types: each end of a hole looks one slice on.
    lower, upper = {j for _, j in edges}, {i for i, _ in edges}
    open_: dict[int, bool] = {}
    for i, n in enumerate(nodes):
        if n["hole"]:
            for linked, step in ((lower, -1), (upper, 1)):
                if i not in linked:
                    k = at[key(n["z"])] + step
                    beyond = by_z.get(key(zs[k]), ()) if 0 <= k < len(zs) else ()
                    closed = any(not nodes[j]["hole"] and not K.relate([("+", nodes[j]["ring"])], [("+", n["ring"])]) & K.EI for j in beyond)
                    open_[find(i)] = open_.get(find(i), False) or not closed
    # Caps: half-way to the next slice of the set, a quarter of the spacing at its ends.
    gaps = np.diff(zs)
    step = float(np.median(gaps)) if len(gaps) else 0.0
    caps = []
    for i, n in enumerate(nodes):
        k = at[key(n["z"])]
        side = -1 if i not in lower else 1 if i not in upper else 0
        if side and step:
            beyond = zs[k + side] if 0 <= k + side < len(zs) else zs[k] + side * step / 2
            try:
                caps.append((i, round(new_slice([zs[k], beyond]), 4)))
            except ValueError:  # slices closer than positions are told apart
                continue
    capped = {i for i, _ in caps}
    for i, z in caps:
        n = nodes[i]
        nodes.append({**n, "z": z, "cap": True, "made": True, "inside": None, "of": i})
        root.append(find(i))
        # What is related and goes on is copied, as no boundary.
        related = [j for j, m in enumerate(nodes[: len(solid_of)]) if (m["inside"] == i or n["inside"] == j) and j not in capped]
        for j in related:
            nodes.append({**nodes[j], "z": z, "cap": False, "made": True, "inside": None, "of": j})
            root.append(find(j))
    solid_roots = sorted({find(i) for i, n in enumerate(nodes) if not n["hole"]})
    first = {r: min((n["z"], -abs(K.ring_area(n["ring"]))) for i, n in enumerate(nodes) if find(i) == r) for r in solid_roots}
    regions = sorted(solid_roots, key=lambda r: (first[r][0], first[r][1], r))
    label = {r: chr(65 + k % 26) + ("" if k < 26 else str(k // 26 - 1)) for k, r in enumerate(regions)}
    for i, n in enumerate(nodes):
        n["region"] = find(i)
        n["label"] = label.get(find(i), "")
        n["open"] = bool(open_.get(find(i), False))
        n["hole_type"] = "None" if not n["hole"] else "Open" if n["open"] else "Closed" if find(i) in open_ else "Unknown"
    return {"nodes": nodes, "edges": edges, "n_original": len(solid_of), "regions": len(regions), "bad": bad}


#: A contour or cap: its place in its structure, its links upwards, its shares of volumes.
NODES = (
    "set_id string, roi int, node int, z double, ring array<double>, area double, is_hole boolean, hole_type string, is_open boolean, "
    "is_cap boolean, is_made boolean, of int, region int, label string, up array<int>, physical double, exterior double, hull double, problem string"
)


def _nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one structure's contours."""
    return pa.concat_tables(_node_rows(pa.Table.from_pandas(pdf, preserve_index=False), np.zeros(1, dtype=np.int64))).to_pandas()


def _with_names(found: list[pa.Table], t: pa.Table, starts: np.ndarray, schema: str) -> pa.Table:
    """The rows found for each structure, with its set and number."""
    rows, owner = repeated(found)
    for k, c in enumerate(("set_id", "roi")):
        rows = rows.add_column(k, c, t[c].take(pa.array(starts[owner])))
    return rows.select(arrow_schema(schema).names)


def _own_rows(rows: list[tuple], schema: str) -> pa.Table:
    """Rows of one structure without its set and number, which are the first two columns."""
    kinds = list(arrow_schema(schema))[2:]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(list(x), type=f.type) for f, x in zip(kinds, columns, strict=True)], names=[f.name for f in kinds])


def _node_rows(t: pa.Table, starts: np.ndarray):
    ends = np.append(starts[1:], t.num_rows)
    zs = t["zs"].take(pa.array(starts))
    names = list(zip(names_of(t, starts, ("z", "xy")), names_of(pa.table({"zs": zs}), np.arange(len(starts)), ("zs",)), strict=True))

    def fresh(at: list[int]) -> list[pa.Table]:
        return [_own_rows(_built(t.slice(starts[i], ends[i] - starts[i]).select(["z", "xy"]).to_pandas(), zs[i].as_py()), NODES) for i in at]

    yield _with_names(_BUILT.many(names, fresh), t, starts, NODES)


def _built(pdf: pd.DataFrame, zs: list[float]) -> list[tuple]:
    """Nodes of one structure, without its set and number."""
    built = build(pd.DataFrame({"z": pdf["z"], "ring": [r.reshape(-1, 2) for r in pdf["xy"]]}), zs)
    own = built["nodes"]
    up: list[list[int]] = [[] for _ in own]
    for i, j in built["edges"]:
        up[i].append(j)
    spans = [*built["edges"], *((i, n["of"]) for i, n in enumerate(own) if n["cap"])]
    volume = np.zeros((len(own), 3))
    hull_area: dict[int, float] = {}
    for i, j in spans:
        a, b = own[i], own[j]
        gap = abs(a["z"] - b["z"])
        v = (abs(K.ring_area(a["ring"])) + abs(K.ring_area(b["ring"]))) / 2 * gap
        for k in (i, j):
            if k not in hull_area:
                hull_area[k] = abs(K.ring_area(K.convex_hull(own[k]["ring"])))
        h = (hull_area[i] + hull_area[j]) / 2 * gap
        volume[i] += (-v if a["hole"] else v, 0 if a["hole_type"] == "Closed" else -v if a["hole"] else v, 0 if a["hole"] else h)
    out = [(i, n["z"], np.round(n["ring"], 9).ravel().tolist(), abs(K.ring_area(n["ring"])), n["hole"], n["hole_type"], n["open"], n["cap"], n["made"], n.get("of", -1), n["region"], n["label"], up[i], *volume[i].tolist(), None) for i, n in enumerate(own)]
    out += [(-1, z, r.ravel().tolist(), abs(K.ring_area(r)), False, "None", False, False, False, -1, -1, "", [], 0.0, 0.0, 0.0, why) for z, r, why in built["bad"]]
    return out


def nodes(contours: DataFrame) -> DataFrame:
    """Contours and caps of every structure of (set_id, roi, z, points), with links and shares
    of volumes. Rings that can't be used have a ``problem`` and no other part; the set's
    sequence is its slices with a usable position and ring. Worth writing where several
    steps follow."""
    if "node" in contours.columns:
        return contours
    checked = check_contours(contours.select("set_id", "roi", "z", "points"))
    good = checked.where("problem is null").drop("problem")
    seq = good.groupBy("set_id").agg(F.sort_array(F.collect_set("z")).alias("zs"))
    xy = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"])))
    got = good.select("set_id", "roi", "z", xy.alias("xy")).join(seq, "set_id")
    got = in_groups(got, ("set_id", "roi"), ("z", "xy"), _node_rows, NODES)
    fields = {"set_id": F.col("set_id"), "roi": F.col("roi"), "z": F.col("z"), "ring": xy, "problem": F.col("problem"), "node": F.lit(-1), "of": F.lit(-1), "region": F.lit(-1)}
    bad = checked.where("problem is not null").select(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in NODES.split(", "))])
    return got.unionByName(bad)


def quarantined(contours: DataFrame) -> DataFrame:
    """(set_id, roi, z, ring, problem): rings that were set aside, and why."""
    return nodes(contours).where("problem is not null").select("set_id", "roi", "z", "ring", "problem")


def usable(contours: DataFrame) -> DataFrame:
    return nodes(contours).where("problem is null")


def infill(own: list[dict], edges: list[tuple[int, int]], zs: list[float]) -> list[dict]:
    """Rings for slices of the whole sequence strictly inside an edge; each in-fill splits
    what remains above it, so later ones lie half-way between the last and the target."""
    out = []
    spans = [(own[i], own[j]) for i, j in edges]
    spans += [(own[n["of"]], n) if n["z"] > own[n["of"]]["z"] else (n, own[n["of"]]) for n in own if n["cap"]]
    for lo, hi in spans:
        low = lo["ring"]
        for z in zs:
            if key(lo["z"]) < key(z) < key(hi["z"]):
                low = half_way(low, hi["ring"])
                out.append({**lo, "z": z, "ring": low, "cap": False, "made": True})
    return out


def assemble(nodes: list[dict]) -> dict:
    """One slice's region, boundary and exterior, as regions of the kernel. Contours count
    from the largest to the smallest; at the end of a hole the hole leaves the boundary, and
    what of the region so far lies in it is a boundary."""
    region, edge, outer = [], [], []
    ends = []
    for n in sorted(nodes, key=lambda n: -abs(K.ring_area(n["ring"]))):
        r = n["ring"]
        if not n["hole"]:
            (edge if n["cap"] else region).append(("+", r))
            if not n["cap"]:
                outer.append(("+", r))
        elif not n["cap"]:
            region.append(("-", r))
            if n["open"]:
                edge.append(("-", r))
                outer.append(("-", r))
        else:
            edge.append(("-", r))
            if region:
                ends.append([*region, ("&", r)])
    if not any(op == "+" for op, _ in edge):
        edge = []
    for part in ends:
        edge = K.union(edge, part)
    return {"region": region, "boundary": edge, "exterior": outer, "is_cap": any(n["cap"] for n in nodes)}


#: The regions of a slice that are stored.
GEOMETRIES = ("region", "boundary", "exterior", "hull")
_PACKED = ", ".join(f"{g}_ops string, {g}_n array<int>, {g}_xy array<double>" for g in GEOMETRIES)
SLICES = f"set_id string, roi int, zk long, z double, {_PACKED}, is_boundary boolean, is_interpolated boolean, has_region boolean, labels array<string>, cap_labels array<string>"


def geometry(row, name: str) -> K.Region:
    """A stored region of a row (a mapping)."""
    return K.unpack(row[f"{name}_ops"], row[f"{name}_n"], row[f"{name}_xy"])


#: What makes a node of a structure.
_PLAIN = ("z", "ring", "is_hole", "is_open", "is_cap", "is_made", "of", "region", "label", "up")


def _own_nodes(t: pa.Table) -> tuple[list[dict], list[tuple[int, int]]]:
    rows = t.select(list(_PLAIN)).to_pylist()
    own = [{"z": r["z"], "ring": np.asarray(r["ring"], dtype=float).reshape(-1, 2), "hole": r["is_hole"], "open": r["is_open"], "cap": r["is_cap"], "made": r["is_made"], "of": r["of"], "region": r["region"], "label": r["label"]} for r in rows]
    return own, [(i, j) for i, r in enumerate(rows) for j in r["up"]]


def _prefixed(labels, owner: np.ndarray, roi) -> pa.Array:
    """Lists of labels, each with the number of its structure before it."""
    own = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
    size = pc.list_value_length(own).to_numpy(zero_copy_only=False)
    whose = roi.take(pa.array(np.repeat(owner, size)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), type=pa.int32()), pc.binary_join_element_wise(pc.cast(whose, pa.string()), own.flatten(), ""))


def _structure_rows(t: pa.Table, starts: np.ndarray):
    ends = np.append(starts[1:], t.num_rows)
    zs = t["all_z"].take(pa.array(starts))
    names = list(zip(names_of(t, starts, _PLAIN), names_of(pa.table({"zs": zs}), np.arange(len(starts)), ("zs",)), strict=True))
    found = _CUT.many(names, lambda at: [_own_rows(_cut(*_own_nodes(t.slice(starts[i], ends[i] - starts[i])), zs[i].as_py()), SLICES) for i in at])
    rows = _with_names(found, t, starts, SLICES)
    roi = rows["roi"].combine_chunks()
    for c in ("labels", "cap_labels"):
        rows = rows.set_column(rows.schema.get_field_index(c), c, _prefixed(rows[c], np.arange(rows.num_rows), roi))
    yield rows


def _cut(own: list[dict], edges: list[tuple[int, int]], zs: list[float]) -> list[tuple]:
    """Slices of one structure, without its set and number."""
    out = []
    by: dict[int, list] = {}
    for n in [*own, *infill(own, edges, zs)]:
        by.setdefault(key(n["z"]), []).append(n)
    labels_of = lambda nodes: sorted({n["label"] for n in nodes if not n["hole"]})
    for zk, here in sorted(by.items()):
        real = [n for n in here if not n["made"]]
        use = real if real else here
        one = assemble(use)
        one["hull"] = [("+", K.convex_hull(np.concatenate([n["ring"] for n in use if n["region"] == r and not n["hole"]]))) for r in sorted({n["region"] for n in use if not n["hole"]})]
        packed = [x for g in GEOMETRIES for x in K.pack(one[g])]
        out.append((zk, use[0]["z"], *packed, bool(one["is_cap"]), not real, any(op == "+" for op, _ in one["region"]), labels_of(use), labels_of([n for n in use if n["cap"]])))
    return out


def region_slices(contours: DataFrame) -> DataFrame:
    """Region slices of every structure, with caps and in-fill.

    The set's sequence is its distinct slices; the caps of all its structures are added
    before in-fill, so a structure is cut at its neighbours' caps as well."""
    own = usable(contours)
    all_z = own.where("not is_made or is_cap").groupBy("set_id").agg(F.sort_array(F.collect_set("z")).alias("all_z"))
    return in_groups(own.join(all_z, "set_id"), ("set_id", "roi"), ("node",), _structure_rows, SLICES)


def select(slices: DataFrame, what: str) -> DataFrame:
    """(set_id, roi, zk, z, ops, n, xy) of one of a slice's regions: contour, exterior, hull or
    boundary, or all, which is the region and its boundary together."""
    names = {"contour": "region", "exterior": "exterior", "hull": "hull", "boundary": "boundary"}
    if what not in (*names, "all"):
        raise ValueError(f"{what} is none of {(*names, 'all')}")
    keys = ["set_id", "roi", "zk", "z"]
    if what != "all":
        return slices.select(*keys, *[F.col(f"{names[what]}_{c}").alias(c) for c in ("ops", "n", "xy")])
    both = (F.col("region_ops") != "") & (F.col("boundary_ops") != "")
    ops = F.concat("region_ops", F.when(both, "|").otherwise(""), "boundary_ops")
    sizes = F.concat("region_n", F.when(both, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), "boundary_n")
    return slices.select(*keys, ops.alias("ops"), sizes.alias("n"), F.concat("region_xy", "boundary_xy").alias("xy"))


def contour_report(contours: DataFrame) -> DataFrame:
    """(set_id, roi, z, area, is_hole, hole_type, region, is_boundary) of every contour."""
    return usable(contours).select("set_id", "roi", "z", "area", "is_hole", "hole_type", F.concat(F.col("roi").cast("string"), "label").alias("region"), F.col("is_cap").alias("is_boundary"))


def volumes(contours: DataFrame, by: tuple[str, ...] = ("hull", "exterior", "physical")) -> DataFrame:
    """(set_id, roi, physical, exterior, hull, num_regions, place): volumes from the matches of
    contours, the number of regions, and the place by falling volumes, equal ones by number."""
    names = ("physical", "exterior", "hull")
    if not by or set(by) - set(names):
        raise ValueError(f"volumes to order by are some of {names}")
    regions_ = F.count_distinct(F.when(~F.col("is_hole"), F.col("region"))).cast("int")
    got = usable(contours).groupBy("set_id", "roi").agg(*[F.sum(c).alias(c) for c in names], regions_.alias("num_regions"))
    return got.withColumn("place", F.row_number().over(Window.partitionBy("set_id").orderBy(*[F.desc(c) for c in by], "roi")))


def summary(contours: DataFrame, rois: DataFrame | None = None, tolerance: float = 0.01) -> DataFrame:
    """(set_id, roi, the three volumes rounded to the tolerance, num_contours, num_regions,
    num_slices, slice_range), over original slices; with ``rois`` (set_id, roi, name and more)
    their columns too."""
    from ..functions.scalars import round_value, slice_label

    own = usable(contours)
    vol = volumes(own).select("set_id", "roi", *[round_value(F.col(c), tolerance).alias(c) for c in ("physical", "exterior", "hull")], "num_regions")
    num = own.where("not is_made").groupBy("set_id", "roi").agg(F.count("*").alias("num_contours"), F.count_distinct("z").alias("num_slices"), F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    out = vol.join(num, ["set_id", "roi"]).withColumn("slice_range", F.concat(slice_label(F.col("_lo")), F.lit(" to "), slice_label(F.col("_hi")))).drop("_lo", "_hi")
    return out if rois is None else out.join(rois, ["set_id", "roi"], "left")


def _equal(a: K.Region, b: K.Region) -> bool:
    return len(a) == len(b) and all(p == q and len(x) == len(y) and (x == y).all() for (p, x), (q, y) in zip(a, b, strict=True))


class Shape:
    """What a structure is on a slice: its regions, read once, and what quick tests need."""

    def __init__(self, row: dict):
        self.number, self.cap = next(_NUMBERS), bool(row["is_boundary"])
        self.real = bool(row["has_region"]) and (not row["is_interpolated"] or self.cap)
        self.present = bool(row["has_region"])
        self.made = bool(row["is_interpolated"])
        self.compared = not self.made or self.cap
        self.parts = {g: geometry(row, g) for g in GEOMETRIES}
        self.bounds = {g: K.bounds(r) for g, r in self.parts.items()}
        self.full = {g: bool(len(K.boundary(r))) for g, r in self.parts.items() if g != "boundary"}
        region = self.parts["region"]
        self.filled = _equal(region, self.parts["exterior"])
        self.convex = len(region) == 1 and len(self.parts["hull"]) == 1 and K.is_convex(region[0][1])

    def has(self, name: str) -> bool:
        return self.bounds[name] is not None


def _nine_to(bits9: int, a_cap: bool, b_cap: bool) -> int:
    target = K.BB if a_cap and b_cap else K.BI if a_cap else K.IB
    return (target if bits9 & K.II else 0) << 18


def pair_bits(pairs: list[tuple[Shape, Shape]]) -> list[int]:
    """27 bits of pairs of structures on one slice. What has to be compared is listed first
    and compared in one go; boxes that don't meet are answered at once."""
    bits, todo, wanted = [0] * len(pairs), [], []

    def ask(k: int, name_a: str, name_b: str, shifts: tuple[int, ...], caps=None) -> None:
        a, b = pairs[k]
        if not K.apart(a.bounds[name_a], b.bounds[name_b]):
            todo.append((a.parts[name_a], b.parts[name_b]))
            wanted.append((k, shifts, caps))
        elif caps is None:
            # All that matters is that each is not empty.
            nine = K.EE + (K.IE | K.BE if a.full[name_a] else 0) + (K.EI | K.EB if b.full[name_b] else 0)
            for s in shifts:
                bits[k] |= nine << s

    for k, (a, b) in enumerate(pairs):
        if not a.cap and not b.cap and a.has("region") and b.has("region"):
            # Exteriors and hulls that are the regions themselves need no comparison.
            same = [18]
            for name, plain, shift in (("exterior", "filled", 9), ("hull", "convex", 0)):
                if getattr(a, plain) and getattr(b, plain):
                    same.append(shift)
                elif a.has(name) and b.has(name):
                    ask(k, name, name, (shift,))
                else:
                    bits[k] |= K.relate(a.parts[name], b.parts[name]) << shift
            ask(k, "region", "region", tuple(same))
        for name_a, name_b in (("region", "boundary"), ("boundary", "region"), ("boundary", "boundary")):
            if a.has(name_a) and b.has(name_b):
                ask(k, name_a, name_b, (), (name_a == "boundary", name_b == "boundary"))
    for (k, shifts, caps), nine in zip(wanted, K.relate_many(todo).tolist(), strict=True):
        if caps is not None:
            bits[k] |= _nine_to(nine, *caps)
        for s in shifts:
            bits[k] |= nine << s
    return bits


def _known_pairs(memory: Known, shapes: list, number: np.ndarray, a: np.ndarray, b: np.ndarray, answer) -> np.ndarray:
    """What ``answer`` gives for pairs of shapes; those with the same numbers are asked for once."""
    code, first, back = np.unique(number[a] << 32 | number[b], return_index=True, return_inverse=True)
    pair = lambda i: (shapes[a[first[i]]], shapes[b[first[i]]])
    return np.array(memory.many(code.tolist(), lambda at: answer([pair(i) for i in at])), dtype=np.int64)[back.ravel()] if len(code) else np.zeros(0, dtype=np.int64)


_SHAPE = ["is_boundary", "is_interpolated", "has_region", *(f"{g}_{c}" for g in GEOMETRIES for c in ("ops", "n", "xy"))]


def _slice_pair_rows(t: pa.Table, starts: np.ndarray):
    n = t.num_rows
    own = t.select(_SHAPE)
    shapes = _SHAPES.many(names_of(own, np.arange(n), _SHAPE), lambda at: [Shape(r) for r in own.take(pa.array(at)).to_pylist()])
    number = np.array([x.number for x in shapes], dtype=np.int64)
    real, present, made, cap, compared = (np.array([getattr(x, c) for x in shapes], dtype=bool) for c in ("real", "present", "made", "cap", "compared"))
    # A row meets all that come after it in its group.
    after = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n) - 1
    for lo, hi in runs(after, AT_ONCE):
        a, k = K._within(after[lo:hi])
        a = a + lo
        b = a + k + 1
        asked = compared[a] | compared[b]
        bits = np.zeros(len(a), dtype=np.int64)
        bits[asked] = _known_pairs(_BITS, shapes, number, a[asked], b[asked], pair_bits)
        at = lambda c, i: t[c].take(pa.array(i))
        yield pa.table([at("set_id", a), at("roi", a), at("roi", b), at("zk", a), bits, (real[a] & present[b]).astype(np.int64), (real[b] & present[a]).astype(np.int64), made[a] | made[b], cap[a] | cap[b]], names=[c.split()[0] for c in PAIR_SLICES.split(", ")])


PAIR_SLICES = "set_id string, roi_a int, roi_b int, zk long, bits int, met_a int, met_b int, is_interpolated boolean, has_boundary boolean"


def _placed(shapes: DataFrame, order: DataFrame) -> DataFrame:
    """``shapes`` of structures in the order, with their place. The order comes as one map for
    each set."""
    places = order.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("roi", "place"))).alias("places"))
    return shapes.join(places, "set_id").withColumn("place", F.try_element_at("places", "roi")).drop("places").where("place is not null")


def slice_relations(slices: DataFrame, order: DataFrame) -> DataFrame:
    """Bits of every pair on every slice that both have; 0 where only in-fill meets."""
    placed = _placed(slices, order).select("set_id", "roi", "zk", "place", *_SHAPE)
    return in_groups(placed, ("set_id", "zk"), ("place", "roi"), _slice_pair_rows, PAIR_SLICES)


def pairs_of(order: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b) of every two structures of a set, the first before the second."""
    p, q = order.alias("p"), order.alias("q")
    on = (F.col("p.set_id") == F.col("q.set_id")) & (F.col("p.place") < F.col("q.place"))
    return p.join(q, on).select(F.col("p.set_id").alias("set_id"), F.col("p.roi").alias("roi_a"), F.col("q.roi").alias("roi_b"))


def relations(slices: DataFrame, order: DataFrame, met: DataFrame | None = None, new: list[int] | None = None) -> DataFrame:
    """(set_id, roi_a, roi_b, bits, relation) of every pair; ``order``: (set_id, roi, place),
    the larger structure first. Positions that only in-fill reaches are left out. ``met``:
    what :func:`slice_relations` gave, if it is at hand. ``new``: only pairs with one of
    these structures, as when they were added to a set that is done."""
    order = order.select("set_id", "roi", "place")
    pairs = pairs_of(order)
    if new is not None:
        pairs = pairs.where(F.col("roi_a").isin(new) | F.col("roi_b").isin(new))
    met = slice_relations(slices, order) if met is None else met
    merged = met.groupBy("set_id", "roi_a", "roi_b").agg(F.bit_or("bits").alias("bits"), F.sum("met_a").alias("met_a"), F.sum("met_b").alias("met_b"))
    # A structure's slices on which the other has nothing: those that weren't met.
    own = slices.where("has_region and (not is_interpolated or is_boundary)").groupBy("set_id", "roi").agg(F.count("*").alias("n"))
    side = lambda x: own.select("set_id", F.col("roi").alias(f"roi_{x}"), F.col("n").alias(f"n_{x}"))
    got = pairs.join(merged, ["set_id", "roi_a", "roi_b"], "left").join(side("a"), ["set_id", "roi_a"], "left").join(side("b"), ["set_id", "roi_b"], "left")
    alone = lambda x, bits: F.when(F.coalesce(f"n_{x}", F.lit(0)) > F.coalesce(f"met_{x}", F.lit(0)), F.lit(bits)).otherwise(F.lit(0))
    bits = F.coalesce("bits", F.lit(0)).bitwiseOR(alone("a", bitcols.ONLY_A)).bitwiseOR(alone("b", bitcols.ONLY_B)).cast("int")
    return got.select("set_id", "roi_a", "roi_b", bits.alias("bits")).withColumn("relation", D.classify(F.col("bits")))


def add_structures(done: DataFrame, slices: DataFrame, order: DataFrame, new: list[int]) -> DataFrame:
    """Relations of a set to which structures ``new`` were added: ``done`` relations stay
    (turned where the order of two structures changed), those with new ones are made."""
    turned = done.alias("d").join(order.alias("p"), (F.col("d.set_id") == F.col("p.set_id")) & (F.col("d.roi_a") == F.col("p.roi"))).join(order.alias("q"), (F.col("d.set_id") == F.col("q.set_id")) & (F.col("d.roi_b") == F.col("q.roi")))
    back = F.col("p.place") > F.col("q.place")
    pick = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    kept = turned.where(~F.col("d.roi_a").isin(new) & ~F.col("d.roi_b").isin(new)).select(F.col("d.set_id").alias("set_id"), pick("d.roi_a", "d.roi_b").alias("roi_a"), pick("d.roi_b", "d.roi_a").alias("roi_b"), F.when(back, bitcols.transpose(F.col("d.bits"))).otherwise(F.col("d.bits")).cast("int").alias("bits"))
    return kept.withColumn("relation", D.classify(F.col("bits"))).unionByName(relations(slices, order, new=new))


def is_complete(done: DataFrame, order: DataFrame) -> DataFrame:
    """(set_id, complete): whether a set has a relation for every pair of its structures, so
    that nothing needs to be made again."""
    n = order.groupBy("set_id").agg(F.count("*").alias("n"))
    have = done.groupBy("set_id").agg(F.count("*").alias("have"))
    return n.join(have, "set_id", "left").select("set_id", (F.coalesce("have", F.lit(0)) >= F.col("n") * (F.col("n") - 1) / 2).alias("complete"))


REGIONS = "set_id string, roi int, zk long, label string, ops string, n array<int>, xy array<double>, is_boundary boolean"


def _region_rows(t: pa.Table, starts: np.ndarray):
    ends = np.append(starts[1:], t.num_rows)
    found = _REGIONS.many(names_of(t, starts, _PLAIN), lambda at: [_own_rows(_labelled(_own_nodes(t.slice(starts[i], ends[i] - starts[i]))[0]), REGIONS) for i in at])
    rows = _with_names(found, t, starts, REGIONS)
    yield rows.set_column(rows.schema.get_field_index("label"), "label", pc.binary_join_element_wise(pc.cast(rows["roi"], pa.string()), rows["label"], ""))


def _labelled(own: list[dict]) -> list[tuple]:
    """Regions of one structure, without its set and number."""
    out = []
    by: dict[int, list] = {}
    for n in own:
        by.setdefault(key(n["z"]), []).append(n)
    for zk, here in sorted(by.items()):
        for label in sorted({n["label"] for n in here if not n["hole"]}):
            solids = [n for n in here if n["label"] == label and not n["hole"]]
            inner = [n for n in here if n["hole"] and any(not K.relate([("+", s["ring"])], [("+", n["ring"])]) & K.EI for s in solids)]
            ops = [("+" if not n["hole"] else "-", n["ring"]) for n in sorted([*solids, *inner], key=lambda n: -abs(K.ring_area(n["ring"])))]
            out.append((zk, label, *K.pack(ops), any(n["cap"] for n in solids)))
    return out


def regions(contours: DataFrame) -> DataFrame:
    """Every region of every structure on its slices, with its holes."""
    return in_groups(usable(contours), ("set_id", "roi"), ("node",), _region_rows, REGIONS)


REGION_PAIRS = "set_id string, roi_a int, roi_b int, region_a string, region_b string, bits int"


def _filled(row: dict) -> tuple:
    """A region's number, itself, filled and convex, and its bounds."""
    r = K.unpack(row["ops"], row["n"], row["xy"])
    return next(_NUMBERS), r, K.solid(r), K.hull(r), K.bounds(r)


def _region_bits(pairs: list[tuple]) -> list[int]:
    """27 bits of pairs of regions, as :func:`_filled` gave them."""
    met = [not K.apart(x[4], y[4]) for x, y in pairs]
    todo = [(a, y[1]) for (x, y), m in zip(pairs, met, strict=True) if m for a in x[1:4]]
    nine = iter(K.relate_many(todo).tolist())
    outside = (K.EE | K.IE | K.BE | K.EI | K.EB) * ((1 << 18) + (1 << 9) + 1)
    return [next(nine) << 18 | next(nine) << 9 | next(nine) if m else outside for m in met]


def _region_pair_rows(t: pa.Table, starts: np.ndarray):
    n = t.num_rows
    own = t.select(["ops", "n", "xy"])
    shapes = _LABELLED.many(names_of(own, np.arange(n), own.column_names), lambda at: [_filled(r) for r in own.take(pa.array(at)).to_pylist()])
    number = np.array([x[0] for x in shapes], dtype=np.int64)
    # A region meets those of the structures after its own in its group.
    size = np.diff(np.append(starts, n))
    group = np.repeat(np.arange(len(starts)), size)
    place = t["place"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (group[1:] != group[:-1])]))
    behind = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    count = np.repeat(np.append(starts[1:], n), size) - behind
    for lo, hi in runs(count, AT_ONCE):
        a, k = K._within(count[lo:hi])
        a = a + lo
        b = behind[a] + k
        bits = _known_pairs(_REGION_BITS, shapes, number, a, b, _region_bits)
        at = lambda c, i: t[c].take(pa.array(i))
        yield pa.table([at("set_id", a), at("roi", a), at("roi", b), at("label", a), at("label", b), bits], names=[c.split()[0] for c in REGION_PAIRS.split(", ")])


def region_relations(regions_: DataFrame, order: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, region_a, region_b, bits, relation) of every pair of regions.
    Only slices that both have count, boundary slices like others; the second region's
    filled form and hull are the region itself."""
    got = in_groups(_placed(regions_, order), ("set_id", "zk"), ("place", "label"), _region_pair_rows, REGION_PAIRS)
    names = ["set_id", "roi_a", "roi_b", "region_a", "region_b"]
    return got.groupBy(*names).agg(F.bit_or("bits").alias("bits")).withColumn("relation", D.classify(F.col("bits")))
