"""Set algebra of regions as shapes: the rings that bound what is in one structure, in the
other, in both, in either or in one only, and of each against a third.

The kernel cuts all segments where they meet and knows which pieces have the wanted area on
one side only. Such a piece is a half-edge with the area on its left. From the end of a
half-edge the walk goes on along the next one clockwise, so it stays at one face, and shapes
that meet in a point come out apart. Rings that turn left are shells, the others holes of
the smallest shell around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernel as K
from .known import Known, moved_pairs, pair_names

#: Parts of two regions, by what a point's membership must be.
PARTS = {"a_only": lambda a, b: a & ~b, "b_only": lambda a, b: b & ~a, "both": lambda a, b: a & b, "either": lambda a, b: a | b, "one": lambda a, b: a ^ b}
#: What is compared with a third structure.
DERIVED = ("both", "either", "one", "a_only")

Polygon = tuple  # of a shell and its holes, each a ring


def _next(edges: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The half-edge that follows each: the next one clockwise about its end."""
    ends = np.concatenate([edges[:, :2], edges[:, 2:]])
    _, node = np.unique(np.column_stack([np.tile(group, 2), np.round(ends * 1e7).astype(np.int64)]), axis=0, return_inverse=True)
    tail, head = np.split(node.ravel(), 2)
    d = edges[:, 2:] - edges[:, :2]
    # Angles fill less than eight, so a node's keys never reach those of the next.
    leaves = tail * 8.0 + np.arctan2(d[:, 1], d[:, 0]) + 4
    returns = head * 8.0 + np.arctan2(-d[:, 1], -d[:, 0]) + 4
    order = np.argsort(leaves, kind="stable")
    place = np.searchsorted(leaves[order], returns - 1e-7) - 1
    first = np.searchsorted(tail[order], head)
    last = np.searchsorted(tail[order], head, side="right") - 1
    return order[np.where(place < first, last, place)]


def rings(edges: np.ndarray, group: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(group, ring) of half-edges with the area on their left; points on straight lines are
    left out."""
    if not len(edges):
        return []
    follow = _next(edges, group)
    d = edges[:, 2:] - edges[:, :2]
    turn = d[:, 0] * d[follow, 1] - d[:, 1] * d[follow, 0]
    size = np.hypot(d[:, 0], d[:, 1])
    corner = (np.abs(turn) > 1e-9 * size * size[follow]) | ((d * d[follow]).sum(axis=1) < 0)
    step, kept = follow.tolist(), corner.tolist()
    seen, out = [False] * len(step), []
    for start in range(len(step)):
        at, ring = start, []
        while not seen[at]:
            seen[at] = True
            if kept[at]:
                ring.append(at)
            at = step[at]
        if len(ring) >= 3:
            out.append((int(group[start]), edges[ring, 2:]))
    return out


def polygons(of: list[np.ndarray]) -> list[Polygon]:
    """Shells, largest first, each with the holes for which it is the smallest one around."""
    sized = [(K.ring_area(r), r) for r in of]
    shells = sorted(((a, r, []) for a, r in sized if a > K.SNAP), key=lambda s: -s[0])
    for a, r in sized:
        if a < -K.SNAP:
            d = r[1] - r[0]
            # A point just left of the hole's edge lies in the area that the hole bounds.
            near = (r[0] + r[1]) / 2 + np.array([-d[1], d[0]]) / np.hypot(*d) * 1e-7
            around = [s for s in shells if K.inside_ring(near[None], s[1])[0]]
            if around:
                around[-1][2].append(r)
    return [(r, holes) for _, r, holes in shells]


def area(p: Polygon) -> float:
    return K.ring_area(p[0]) + sum(K.ring_area(h) for h in p[1])


def shapes_of(regions: list[K.Region], keep) -> list[Polygon]:
    """The polygons where ``keep`` of the regions' membership holds."""
    pieces = K.noded(K.segments(*regions))
    if not len(pieces):
        return []
    both = [K.sides(pieces, r) for r in regions]
    edges = half_edges(pieces, keep(*[x for x, _ in both]), keep(*[x for _, x in both]))
    return polygons([r for _, r in rings(edges, np.zeros(len(edges), dtype=np.int64))])


def half_edges(pieces: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pieces with the area on one side, turned so that it is on their left."""
    return np.concatenate([pieces[left & ~right], pieces[right & ~left][:, [2, 3, 0, 1]]])


def overlay_many(pairs: list[tuple[K.Region, K.Region]], parts=tuple(PARTS)) -> list[dict[str, list[Polygon]]]:
    """The polygons of the parts of every pair, all pairs cut and walked in the same arrays."""
    out: list[dict[str, list[Polygon]]] = [{p: [] for p in parts} for _ in pairs]
    lo = 0
    while lo < len(pairs):
        run = pairs[lo : lo + 256]
        pieces, pair, (al, ar, bl, br) = K._sides_of(run)
        for name in parts:
            left, right = PARTS[name](al, bl), PARTS[name](ar, br)
            edges = half_edges(pieces, left, right)
            found: dict[int, list] = {}
            for k, ring in rings(edges, np.concatenate([pair[left & ~right], pair[right & ~left]])):
                found.setdefault(k, []).append(ring)
            for k, of in found.items():
                out[lo + k][name] = polygons(of)
        lo += len(run)
    return out


def repaired(ring: np.ndarray) -> np.ndarray:
    """A ring as it is if it does not cross itself, else the shell of the largest face of what
    it encloses by the even-odd rule; no points if it encloses nothing."""
    if K.is_simple(ring):
        return ring
    faces = shapes_of([[("+", ring)]], lambda x: x)
    return max(faces, key=area)[0] if faces else K.NO_RING


SHAPES = "part string, polygon int, shell array<double>, holes array<array<double>>, area double"


def _rows(parts: dict[str, list[Polygon]]):
    for name, found in parts.items():
        for k, p in enumerate(found):
            yield name, k, p[0].ravel().tolist(), [h.ravel().tolist() for h in p[1]], area(p)


def overlays(pairs: DataFrame, keys: list[str], margin: float = 0.0) -> DataFrame:
    """``keys`` with (part, polygon, shell, holes, area): a row for every polygon of every part
    of two regions. ``pairs`` has the regions as a_ops, a_n, a_xy and b_...; with c_... each
    derived shape is set against the third as well, in parts such as both:only, both:c_only
    and both:common. A ``margin`` adds the bands around both boundaries, of that width in
    all, as band_a and band_b. Rows are worked off as they stand, without a shuffle."""
    ship(pairs.sparkSession)
    third = "c_ops" in pairs.columns
    region = lambda row, x: K.unpack(row[f"{x}_ops"], row[f"{x}_n"], row[f"{x}_xy"])

    def run(batches):
        for b in batches:
            given = b.to_pylist()
            both = [(region(r, "a"), region(r, "b")) for r in given]
            index, out = [], []
            for i, parts in enumerate(overlay_many(both)):
                if third:
                    c = region(given[i], "c")
                    for name in DERIVED:
                        for tail, keep in (("only", lambda x, y: x & ~y), ("c_only", lambda x, y: y & ~x), ("common", lambda x, y: x & y)):
                            parts[f"{name}:{tail}"] = shapes_of([*both[i], c], lambda x, y, z, n=name, keep=keep: keep(PARTS[n](x, y), z))
                if margin:
                    for x, r in zip("ab", both[i], strict=True):
                        parts[f"band_{x}"] = shapes_of([K.band(r, margin / 2)], lambda u: u)
                for row in _rows(parts):
                    index.append(i)
                    out.append(row)
            kept = [b.column(c).take(pa.array(index, type=pa.int64())) for c in keys]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(list(x), type=t) for x, t in zip(columns, types, strict=True)]], names=[*keys, "part", "polygon", "shell", "holes", "area"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {SHAPES}")


#: What a worker keeps of the measures of pairs, by their bytes and moved to the origin.
_PAIRS, _MOVED = Known(200_000), Known(200_000)


def _measures(given: list) -> list[list[tuple]]:
    """(part, n_polygons, n_holes, n_points, area) of each part of pairs of regions."""
    keys, moved = moved_pairs(given)

    def fresh(at: list[int]) -> list[list[tuple]]:
        points = lambda p: len(p[0]) + sum(map(len, p[1]))
        return [[(name, len(of), sum(len(p[1]) for p in of), sum(map(points, of)), sum(map(area, of))) for name, of in parts.items() if of] for parts in overlay_many([moved[i] for i in at])]

    return _MOVED.many(keys, fresh)


def _known(names: list, region) -> list[list[tuple]]:
    return _PAIRS.many(names, lambda at: _measures([region(i) for i in at]))


def measured(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """What :func:`measures` gives of the :func:`overlays` of two regions, a row of ``pairs`` for
    each value of ``keys``: the shapes are measured where they are made, so nothing is shuffled."""
    ship(pairs.sparkSession)

    def run(batches):
        for b in batches:
            found = _known(*pair_names(b))
            index = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            columns = list(zip(*(row for f in found for row in f), strict=True)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(index) for c in keys], *[pa.array(list(x), type=t) for x, t in zip(columns, types, strict=True)]], names=[*keys, "part", "n_polygons", "n_holes", "n_points", "area"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", part string, n_polygons long, n_holes long, n_points long, area double")


def slice_pairs(slices: DataFrame, pairs: DataFrame, geometry: str = "region") -> DataFrame:
    """(set_id, roi_a, roi_b, zk and the packed regions a and b) of structure pairs on the
    slices that both have, for :func:`overlays`. ``pairs``: (set_id, roi_a, roi_b)."""

    def side(x: str) -> DataFrame:
        return slices.select("set_id", F.col("roi").alias(f"roi_{x}"), "zk", *[F.col(f"{geometry}_{c}").alias(f"{x}_{c}") for c in ("ops", "n", "xy")])

    return pairs.select("set_id", "roi_a", "roi_b").join(side("a"), ["set_id", "roi_a"]).join(side("b"), ["set_id", "roi_b", "zk"])


def measures(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, part, and of each part the numbers of polygons, holes and points, and the area."""
    points = F.size("shell") / 2 + F.aggregate("holes", F.lit(0.0), lambda s, h: s + F.size(h) / 2)
    return shapes.groupBy(*keys, "part").agg(F.count("*").alias("n_polygons"), F.sum(F.size("holes")).cast("long").alias("n_holes"), F.sum(points).cast("long").alias("n_points"), F.sum("area").alias("area"))
