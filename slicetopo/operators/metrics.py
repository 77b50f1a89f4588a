"""Distances, margins and overlaps of structure pairs, from region slices."""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .groups import arrow_schema, in_groups, names_of
from .known import Known
from .structures import geometry

#: Relations for which a metric applies.
APPLIES = {
    "minimum_distance": ("DISJOINT", "SHELTERS", "BORDERS", "CONFINES"),
    "minimum_margins": ("CONTAINS", "SURROUNDS", "SHELTERS", "PARTITIONED", "CONFINES", "EQUAL"),
    "maximum_margin": ("CONTAINS", "SURROUNDS", "CONFINES", "EQUAL", "PARTITIONED"),
    "volume_overlap": ("OVERLAPS", "PARTITIONED", "CONTAINS", "EQUAL"),
    "surface_overlap": ("BORDERS", "CONFINES"),
}
ZERO = ("EQUAL", "PARTITIONED", "CONFINES")
PAIR = ["set_id", "roi_a", "roi_b"]


#: Metrics by category of a configuration, and directions (x_neg, x_pos, y_neg,
#: y_pos, z_neg, z_pos) by patient orientation.
CATEGORIES = {"margins": ("minimum_margins", "maximum_margin"), "distance": ("minimum_distance",), "volume": ("volume_overlap",), "surface": ("surface_overlap",), "geometry": ()}
ORIENTATIONS = {"HFS": "R L A P I S", "HFP": "L R P A I S", "FFS": "L R A P S I", "FFP": "R L P A S I"}
AXES = ("x_minus", "x_plus", "y_minus", "y_plus", "z_minus", "z_plus")


@dataclass(frozen=True)
class Config:
    """What metrics are calculated and how they are shown; :meth:`from_json` reads a file with
    units, precision, enabled_metrics, margin_settings and non_applicable_handling."""

    categories: tuple[str, ...] = ("margins", "distance", "volume", "surface")
    orthogonal: bool = True
    minimum: bool = True
    maximum: bool = False
    distance_decimals: int = 2
    ratio_decimals: int = 3
    unit: str = "cm"
    orientation: str = "HFS"
    anatomical: bool = True
    not_applicable: str = "nan"

    def __post_init__(self):
        if unknown := set(self.categories) - set(CATEGORIES):
            raise ValueError(f"unknown categories {sorted(unknown)}")
        if self.distance_decimals < 0 or self.ratio_decimals < 0:
            raise ValueError("decimals are negative")
        if self.orientation not in ORIENTATIONS:
            raise ValueError(f"orientation is one of {tuple(ORIENTATIONS)}")
        if self.not_applicable not in ("nan", "none", "zero"):
            raise ValueError("not_applicable is nan, none or zero")

    @classmethod
    def from_json(cls, text: str) -> Config:
        raw = json.loads(text)
        modes = [m.removeprefix("use_") for m, on in raw.get("non_applicable_handling", {"use_nan": True}).items() if m.startswith("use_") and on]
        if len(modes) != 1:
            raise ValueError("exactly one way to show what does not apply")
        on = tuple(c for c in CATEGORIES if raw.get("enabled_metrics", {}).get(c, c != "geometry"))
        margins_, places = raw.get("margin_settings", {}), raw.get("precision", {})
        labels = margins_.get("anatomical_labels", {})
        return cls(on, margins_.get("calculate_orthogonal", True), margins_.get("calculate_minimum", True), margins_.get("calculate_maximum", False), places.get("distance", 2), places.get("ratio", 3), raw.get("units", {}).get("distance", "cm"), labels.get("default_orientation", "HFS"), labels.get("use_anatomical", True), modes[0])

    def metrics(self) -> list[str]:
        names = [n for c in self.categories for n in CATEGORIES[c]]
        return [n for n in names if (n != "minimum_margins" or self.orthogonal or self.minimum) and (n != "maximum_margin" or self.maximum)]


class Cut:
    """A structure on a slice, its region and boundary together; what pairs ask for more than
    once is worked out once."""

    def __init__(self, row: dict):
        self.zk, self.z, self.labels = row["zk"], row["z"], list(row["labels"])
        self.all = K.union(geometry(row, "region"), geometry(row, "boundary"))
        self.bounds = K.bounds(self.all)

    @cached_property
    def boundary(self) -> np.ndarray:
        return K.boundary(self.all)

    @cached_property
    def solid(self) -> K.Region:
        return K.solid(self.all)

    @cached_property
    def centroid(self) -> np.ndarray:
        """That of the area; of the largest outline where there is no area."""
        c = K.region_centroid(self.all)
        return K.centroid(max((r for _, r in self.solid if len(r)), key=lambda r: abs(K.ring_area(r)))) if np.isnan(c).any() else c


#: Structures along a side of a tile of pairs.
TILE = 8
Cuts = dict[int, list[Cut]]
#: What a worker keeps of structures, of their pairs and of areas.
_STACKS, _PAIRS, _AREAS = Known(2048), Known(50_000), Known(50_000)
_NUMBERS = itertools.count()


#: What makes a structure's slices.
_GEOMETRY = [f"{g}_{c}" for g in ("region", "boundary") for c in ("ops", "n", "xy")]
_STACK = ["zk", "z", "labels", *_GEOMETRY]


def _tile_rows(each, schema: str, t: pa.Table, starts: np.ndarray):
    """``each`` over the pairs of tiles: rows without ``roi_b`` are slices of structures, by
    structure and slice, the others are pairs. Pairs of equal structures are asked for once."""
    n = t.num_rows
    is_pair = t["roi_b"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    cut, pair = np.flatnonzero(~is_pair), np.flatnonzero(is_pair)
    code = lambda at, c: tile[at] << 32 | (t[c].take(pa.array(at)).to_numpy().astype(np.int64) + (1 << 31))
    own, of = t.select(_STACK).take(pa.array(cut)), code(cut, "roi")
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, dtype=np.int64)
    ends = np.append(first[1:], len(of))
    stacks = _STACKS.many(names_of(own, first, _STACK), lambda at: [(next(_NUMBERS), list(map(Cut, own.slice(first[i], ends[i] - first[i]).to_pylist()))) for i in at])
    # The last, without slices, stands for structures that have none.
    stacks = [*stacks, (-1, [])]
    number, known = np.array([k for k, _ in stacks], dtype=np.int64), of[first]

    def side(c: str) -> np.ndarray:
        wanted = code(pair, c)
        at = np.searchsorted(known, wanted)
        return np.where(np.append(known, -1)[at] == wanted, at, len(known))

    a, b = side("roi"), side("roi_b")
    _, some, back = np.unique(np.stack([number[a], number[b]], axis=1), axis=0, return_index=True, return_inverse=True)
    todo = list(zip(number[a[some]].tolist(), number[b[some]].tolist(), strict=True))

    def fresh(at: list[int]) -> list:
        got: dict = {todo[i]: [] for i in at}
        cuts: Cuts = dict(stacks[x[some[i]]] for i in at for x in (a, b))
        for x, y, *rest in each(cuts, [todo[i] for i in at]):
            got[x, y].append(rest)
        return [got[todo[i]] for i in at]

    found = _PAIRS.many([(each.__name__, *k) for k in todo], fresh)
    size = np.array([len(f) for f in found], dtype=np.int64)
    back = back.ravel()
    owner, k = K._within(size[back])
    at = pa.array((np.cumsum(size) - size)[back][owner] + k, type=pa.int64())
    kinds = list(arrow_schema(schema))
    columns = list(zip(*(r for f in found for r in f), strict=True)) or [()] * (len(kinds) - 3)
    rows = pa.array(pair[owner])
    names = [t[c].take(rows) for c in ("set_id", "roi", "roi_b")]
    yield pa.table([*names, *(pa.array(list(x), type=f.type).take(at) for f, x in zip(kinds[3:], columns, strict=True))], names=[f.name for f in kinds])


def _in_tiles(slices: DataFrame, pairs: DataFrame, each, schema: str) -> DataFrame:
    """``each(cuts, wanted)`` over tiles of a set's pairs, as rows. A set's structures are dealt
    into rows and columns of about ``TILE``, so a task has the pairs of one tile and only the
    slices of their structures, and a large set is spread like many small ones."""
    both = F.explode(F.array("roi_a", "roi_b")).alias("roi")
    sizes = pairs.select("set_id", both).groupBy("set_id").agg(F.ceil(F.count_distinct("roi") / TILE).alias("tiles"))
    tile = lambda c: F.pmod(F.xxhash64(c), F.col("tiles"))
    dealt = pairs.select(*PAIR).join(sizes, "set_id").select(*PAIR, tile("roi_a").alias("row_tile"), tile("roi_b").alias("column_tile"))
    tiles = ("set_id", "row_tile", "column_tile")
    needed = dealt.select(*tiles, both).distinct()
    own = slices.select("set_id", "roi", *_STACK).join(needed, ["set_id", "roi"])
    mixed = own.unionByName(dealt.select(*tiles, F.col("roi_a").alias("roi"), "roi_b"), allowMissingColumns=True)
    return in_groups(mixed, tiles, ("roi_b", "roi", "zk"), partial(_tile_rows, each, schema), schema)


def _common(cuts: Cuts, todo: list[tuple[int, int]]) -> list[tuple[int, int, Cut, Cut]]:
    """Each pair's cuts on the slices that both have."""
    by_slice = {roi: {c.zk: c for c in own} for roi, own in cuts.items()}
    return [(a, b, x, by_slice[b][x.zk]) for a, b in todo for x in cuts.get(a, ()) if x.zk in by_slice.get(b, ())]


def _nearest(a: list[Cut], b: list[Cut]):
    """The least distance over pairs of slices. What the boxes round slices and their distance
    along z allow comes first, and once that is no less than the best, the rest can't be."""
    a, b = ([x for x in side if x.bounds is not None] for side in (a, b))
    if not a or not b:
        return None
    p, q = np.array([x.bounds for x in a]), np.array([y.bounds for y in b])
    gap = np.maximum(np.maximum(p[:, None, :2] - q[None, :, 2:], q[None, :, :2] - p[:, None, 2:]), 0)
    dz = np.abs(np.array([x.z for x in a])[:, None] - np.array([y.z for y in b])[None])
    least = np.sqrt((gap**2).sum(axis=2) + dz**2)
    best = None
    for k in np.lexsort((dz.ravel(), least.ravel())).tolist():
        i, j = divmod(k, len(b))
        if best is not None and least[i, j] >= best[0]:
            break
        d = K.gap(a[i].boundary, b[j].boundary)
        if d > 0 and not gap[i, j].any() and K.relate(a[i].all, b[j].all) & (K.II | K.BB):
            d = 0.0
        if not math.isnan(d) and (best is None or math.hypot(d, dz[i, j]) < best[0]):
            best = (math.hypot(d, dz[i, j]), i, j)
    return best and (best[0], a[best[1]], b[best[2]])


def _least_distances(cuts: Cuts, todo: list[tuple[int, int]]):
    first = lambda x: x.labels[0] if x.labels else None
    for a, b in todo:
        if found := _nearest(cuts.get(a, []), cuts.get(b, [])):
            d, x, y = found
            yield a, b, round(d, 2), x.z, y.z, first(x), first(y)


DISTANCES = "set_id string, roi_a int, roi_b int, minimum_distance double, z_a double, z_b double, region_a string, region_b string"


def minimum_distance(slices: DataFrame, relations: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, minimum_distance, z_a, z_b, region_a, region_b), rounded to 0.01,
    over all pairs of slices; z and regions are those of the nearest pair of slices."""
    return _in_tiles(slices, relations.where(F.col("relation").isin(*APPLIES["minimum_distance"])), _least_distances, DISTANCES)


MARGINS = "set_id string, roi_a int, roi_b int, z double, labels_a array<string>, labels_b array<string>, nearest double, farthest double, x_plus double, x_minus double, y_plus double, y_minus double"


def _margins(cuts: Cuts, todo: list[tuple[int, int]]):
    """Margins on each slice that both have; whether boundaries meet is asked for all pairs of
    a tile at once."""
    met = [m for m in _common(cuts, todo) if m[2].solid and m[3].solid]
    close = [k for k, (_, _, x, y) in enumerate(met) if not K.apart(x.bounds, y.bounds)]
    touch = {k for k, nine in zip(close, K.relate_many([(met[k][2].all, met[k][3].all) for k in close]).tolist(), strict=True) if nine & K.BB}
    for k, (a, b, x, y) in enumerate(met):
        near = 0.0 if k in touch and len(x.boundary) and len(y.boundary) else K.gap(x.boundary, y.boundary)
        yield a, b, x.z, x.labels, y.labels, near, K.farthest(x.boundary, y.boundary), *K.axis_lengths(x.solid, y.solid, y.centroid).tolist()


def slice_margins(slices: DataFrame, relations: DataFrame) -> DataFrame:
    """Margins of each pair on each slice that both have."""
    return _in_tiles(slices, relations, _margins, MARGINS)


DIRECTIONS = ("x_minus", "x_plus", "y_minus", "y_plus", "z_minus", "z_plus")


def region_margins(slices: DataFrame, relations: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, relation, region_a, region_b, the six directions, minimum,
    maximum) of every pair of regions that have a slice in common, rounded to 0.01.

    A slice's margins are those of all the geometry on it, for each pair of its regions;
    a direction's margin is the least over the pair's slices. The two along z are between
    the ends of the regions. Zero for relations whose boundaries meet by definition."""
    use = relations.where(F.col("relation").isin(*APPLIES["minimum_margins"]))
    both = slice_margins(slices, use).withColumn("region_a", F.explode("labels_a")).withColumn("region_b", F.explode("labels_b"))
    per = both.groupBy(*PAIR, "region_a", "region_b").agg(F.min("nearest").alias("minimum"), F.max("farthest").alias("maximum"), *[F.min(F.round(c, 2)).alias(c) for c in DIRECTIONS[:4]])
    ends = slices.where("has_region").select("set_id", "z", F.explode(F.array_except("labels", "cap_labels")).alias("label")).groupBy("set_id", "label").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    side = lambda x: ends.select("set_id", F.col("label").alias(f"region_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"))
    out = use.select(*PAIR, "relation").join(per, PAIR).join(side("a"), ["set_id", "region_a"]).join(side("b"), ["set_id", "region_b"])
    out = out.withColumns({"z_plus": F.abs(F.col("hi_a") - F.col("hi_b")), "z_minus": F.abs(F.col("lo_b") - F.col("lo_a"))})
    zero = F.col("relation").isin(*ZERO)
    return out.select(*PAIR, "relation", "region_a", "region_b", *[F.when(zero, 0.0).otherwise(F.round(c, 2)).alias(c) for c in (*DIRECTIONS, "minimum", "maximum")])


def margins(slices: DataFrame, relations: DataFrame) -> DataFrame:
    """Least and largest margins of each pair: four directions by rays from the centroid of
    all of the second on a slice, two along z by the ends of the regions, the least distance
    of boundaries and the discrete Hausdorff distance, each the worst of the pairs of regions
    (the largest of ``maximum``). ``region_a`` and ``region_b``: the pair of regions of the
    least distance; ``worst_direction``: that of the least margin. These are null where
    margins are zero by definition."""
    per = region_margins(slices, relations)
    worst = F.array_min(F.array(*[F.struct(F.col(c).alias("v"), F.lit(i).alias("i")) for i, c in enumerate(DIRECTIONS)]))
    closest = F.struct("minimum", "region_a", "region_b")
    got = per.groupBy(*PAIR, "relation").agg(*[F.min(c).alias(c) for c in ("x_plus", "x_minus", "y_plus", "y_minus", "minimum")], F.max("maximum").alias("maximum"), F.min("z_plus").alias("z_plus"), F.min("z_minus").alias("z_minus"), F.min(closest).alias("_c"), F.min(worst).alias("_w"))
    zero = F.col("relation").isin(*ZERO)
    name = F.element_at(F.array(*map(F.lit, DIRECTIONS)), F.col("_w")["i"] + 1)
    return got.withColumns({"region_a": F.when(~zero, F.col("_c")["region_a"]), "region_b": F.when(~zero, F.col("_c")["region_b"]), "worst_direction": F.when(~zero, name)}).drop("_c", "_w")


def maximum_margins(slices: DataFrame, relations: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, relation, maximum, region_a, region_b, z): the largest discrete
    Hausdorff distance over common slices, rounded to 0.01, with its slice and regions; 0,
    without these, for relations whose boundaries meet by definition."""
    use = relations.where(F.col("relation").isin(*APPLIES["maximum_margin"]))
    most = F.max(F.struct(F.round("farthest", 2).alias("v"), (-F.col("z")).alias("down"), F.element_at("labels_a", 1).alias("a"), F.element_at("labels_b", 1).alias("b")))
    per = slice_margins(slices, use).groupBy(*PAIR).agg(most.alias("m"))
    zero = F.col("relation").isin(*ZERO)
    return use.select(*PAIR, "relation").join(per, PAIR).select(*PAIR, "relation", F.when(zero, 0.0).otherwise(F.col("m.v")).alias("maximum"), F.when(~zero, F.col("m.a")).alias("region_a"), F.when(~zero, F.col("m.b")).alias("region_b"), F.when(~zero, -F.col("m.down")).alias("z"))


def _areas(cuts: Cuts, todo: list[tuple[int, int]]):
    """The common area on each slice that both have, of all pairs of a tile at once."""
    met = [m for m in _common(cuts, todo) if m[2].bounds is not None and m[3].bounds is not None and not K.apart(m[2].bounds, m[3].bounds)]
    for (a, b, x, _), common in zip(met, K.common_areas([(x.all, y.all) for _, _, x, y in met]).tolist(), strict=True):
        yield a, b, x.z, common


def _own_areas(t: pa.Table, starts: np.ndarray):
    ends = np.append(starts[1:], t.num_rows)
    area = lambda i: float(sum(K.area(K.union(geometry(r, "region"), geometry(r, "boundary"))) for r in t.select(_GEOMETRY).slice(starts[i], ends[i] - starts[i]).to_pylist()))
    areas = _AREAS.many(names_of(t, starts, _GEOMETRY), lambda at: list(map(area, at)))
    at = pa.array(starts)
    yield pa.table([t["set_id"].take(at), t["roi"].take(at), areas], names=["set_id", "roi", "area"])


#: What a ratio of volumes is taken of: the larger structure for PARTITIONED, else the mean.
BASES = ("auto", "larger", "smaller", "average")


def overlap(slices: DataFrame, relations: DataFrame, basis: str = "auto") -> DataFrame:
    """(set_id, roi_a, roi_b, dice, overlap_ratio, common_area, area_a, area_b). Areas are
    summed over the slices of contours, the common one where both are, each structure's own
    over all of its slices. ``dice``: twice the common area over both; ``overlap_ratio``: the
    common area over what ``basis`` says. Both are 1 for EQUAL."""
    if basis not in BASES:
        raise ValueError(f"basis is one of {BASES}")
    use = relations.where(F.col("relation").isin(*APPLIES["volume_overlap"]))
    own = slices.where("not is_boundary and not is_interpolated")
    per = _in_tiles(own, use, _areas, "set_id string, roi_a int, roi_b int, z double, common double").groupBy(*PAIR).agg(F.sum("common").alias("common_area"))
    area = in_groups(own.select("set_id", "roi", "zk", *_GEOMETRY), ("set_id", "roi"), ("zk",), _own_areas, "set_id string, roi int, area double")
    side = lambda x: area.select("set_id", F.col("roi").alias(f"roi_{x}"), F.col("area").alias(f"area_{x}"))
    got = use.select(*PAIR, "relation").join(per, PAIR).join(side("a"), ["set_id", "roi_a"]).join(side("b"), ["set_id", "roi_b"])
    of = {"larger": F.greatest("area_a", "area_b"), "smaller": F.least("area_a", "area_b"), "average": (F.col("area_a") + F.col("area_b")) / 2}
    base = F.when(F.col("relation") == "PARTITIONED", of["larger"]).otherwise(of["average"]) if basis == "auto" else of[basis]
    one = lambda c: F.when(F.col("relation") == "EQUAL", 1.0).otherwise(c)
    return got.select(*PAIR, one(F.col("common_area") / of["average"]).alias("dice"), one(F.col("common_area") / base).alias("overlap_ratio"), "common_area", "area_a", "area_b")


def _surfaces(cuts: Cuts, todo: list[tuple[int, int]]):
    """Lengths of the common boundary, and of outlines and holes, on slices that both have."""
    for a, b, x, y in _common(cuts, todo):
        yield a, b, x.z, *K.outlines(x.all, y.all)


def surface_overlap(slices: DataFrame, relations: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, common, ratio, share_a, share_b) of lengths over the slices of
    contours that both have. ``ratio``: for BORDERS twice the common length over both
    outlines, for CONFINES the common length over a's holes and b's outline; shares are of each
    one's whole boundary."""
    use = relations.where(F.col("relation").isin(*APPLIES["surface_overlap"]))
    parts = ("common", "outline_a", "hole_a", "outline_b", "hole_b")
    per = _in_tiles(slices.where("not is_boundary and not is_interpolated"), use, _surfaces, "set_id string, roi_a int, roi_b int, z double, " + ", ".join(f"{c} double" for c in parts))
    got = use.select(*PAIR, "relation").join(per.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in parts]), PAIR)
    c = {p: F.col(p) for p in parts}
    ratio = F.when(F.col("relation") == "CONFINES", c["common"] / (c["hole_a"] + c["outline_b"])).otherwise(2 * c["common"] / (c["outline_a"] + c["outline_b"]))
    return got.select(*PAIR, "common", ratio.alias("ratio"), (c["common"] / (c["outline_a"] + c["hole_a"])).alias("share_a"), (c["common"] / (c["outline_b"] + c["hole_b"])).alias("share_b"))


def centroids(nodes: DataFrame) -> DataFrame:
    """(set_id, roi, x, y, z): the centroid of a structure's contours, each by its area, holes
    taken away, on original slices."""
    from ..functions.scalars import ring_centroid

    ring = F.transform(F.sequence(F.lit(0), F.expr("size(ring) div 2") - 1), lambda i: F.struct(F.get("ring", 2 * i).alias("x"), F.get("ring", 2 * i + 1).alias("y")))
    own = nodes.where("problem is null and not is_made").select("set_id", "roi", "z", F.when(F.col("is_hole"), -F.col("area")).otherwise(F.col("area")).alias("w"), ring_centroid(ring).alias("c"))
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w"))
    return own.groupBy("set_id", "roi").agg(mean("c.x").alias("x"), mean("c.y").alias("y"), mean("z").alias("z"))


def centroid_distance(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, distance) of the centroids of each pair."""
    c = centroids(nodes)
    side = lambda x: c.select("set_id", F.col("roi").alias(f"roi_{x}"), *[F.col(u).alias(f"{u}_{x}") for u in "xyz"])
    got = relations.select(*PAIR).join(side("a"), ["set_id", "roi_a"]).join(side("b"), ["set_id", "roi_b"])
    return got.select(*PAIR, F.sqrt(sum(F.pow(F.col(f"{u}_a") - F.col(f"{u}_b"), 2) for u in "xyz")).alias("distance"))


#: Metrics by name; both spellings of a name are known.
REGISTRY = {"minimum_distance": minimum_distance, "minimum_margins": margins, "orthogonal_margins": margins, "minimum_margin": margins, "maximum_margin": maximum_margins, "volume_overlap": overlap, "surface_overlap": surface_overlap}


def register(name: str, metric) -> None:
    if name in REGISTRY:
        raise ValueError(f"metric {name} is registered")
    REGISTRY[name] = metric


def calculate(name: str, slices: DataFrame, relations: DataFrame) -> DataFrame:
    """A registered metric over all pairs it applies to."""
    if name not in REGISTRY:
        raise KeyError(name)
    return REGISTRY[name](slices, relations)


def calculate_all(config: Config, slices: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The metrics that a configuration enables, by name, rounded to its decimals. Pairs to
    which a metric does not apply are shown as the configuration says."""
    out = {}
    shown = {"nan": F.lit(float("nan")), "zero": F.lit(0.0), "none": F.lit(None).cast("double")}[config.not_applicable]
    for name in config.metrics():
        got = calculate(name, slices, relations)
        values = [c for c, t in got.dtypes if t == "double"]
        got = got.withColumns({c: F.round(c, config.ratio_decimals if c in ("dice", "overlap_ratio", "ratio", "share_a", "share_b") else config.distance_decimals) for c in values})
        rest = relations.select(*PAIR).join(got.select(*PAIR), PAIR, "left_anti")
        got = got.unionByName(rest.select(*PAIR, *[shown.alias(c) for c in values]), allowMissingColumns=True)
        out[name] = named_directions(got, config.orientation) if name == "minimum_margins" and config.anatomical else got
    return out


def named_directions(margins_: DataFrame, orientation: str = "HFS") -> DataFrame:
    """Margins with columns for a patient's directions instead of axes."""
    return margins_.withColumnsRenamed(dict(zip(AXES, ORIENTATIONS[orientation].split(), strict=True)))


def is_missing(x: float | None) -> bool:
    return x is None or math.isnan(x)
