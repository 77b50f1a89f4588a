"""Relations of regions whose boundaries have a width: the three zones core, band and outside.

A region's zones are traced once: the band around its boundary, cut from it for the core and
added to it for all that is not outside. A pair then needs its few rings only, and all pairs of
a batch are cut and tested in the same arrays. Every cell of the matrix is an area."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import kernel as K
from . import shapes as S
from .known import Known, moved_pairs, pair_names, region_key

#: Cells but the last, which is always set, by the zones that meet.
CELLS = ((K.II, "core", "core"), (K.IB, "core", "band"), (K.IE, "core", "out"), (K.BI, "band", "core"), (K.BB, "band", "band"), (K.BE, "band", "out"), (K.EI, "out", "core"), (K.EB, "out", "band"))


def as_region(polygons: list[S.Polygon]) -> K.Region:
    """Polygons that don't meet as one region."""
    out: K.Region = []
    for shell, holes in polygons:
        out = K.union(out, [("+", shell), *(("-", h) for h in holes)])
    return out


def zones(region: K.Region, margin: float) -> tuple[K.Region, K.Region]:
    """What is deeper in a region than the margin, and all that is not farther from it."""
    wide = K.band(region, margin)
    core, full = (as_region(S.shapes_of([region, wide], keep)) for keep in (lambda r, w: r & ~w, lambda r, w: r | w))
    return core, full


#: Pairs that are cut at once, and what a worker keeps of regions' zones and of pairs' bits.
AT_ONCE = 64
_ZONES, _MOVED, _BITS = Known(4096), Known(300_000), Known(300_000)
Zones = tuple[K.Region, K.Region]


def relate_zones(pairs: list[tuple[Zones, Zones]]) -> np.ndarray:
    """The nine bits of many pairs of regions, given by their zones."""
    return np.concatenate([np.zeros(0, dtype=np.int64), *(_some(pairs[i : i + AT_ONCE]) for i in range(0, len(pairs), AT_ONCE))])


def _some(pairs: list[tuple[Zones, Zones]]) -> np.ndarray:
    rings = K._Rings([(K.union(*a), K.union(*b)) for a, b in pairs])
    out = np.full(len(pairs), K.EE)
    if not rings.most:
        return out
    pieces, pair = rings.pieces()
    d = pieces[:, 2:] - pieces[:, :2]
    size = np.hypot(d[:, 0], d[:, 1])
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2 + d * 0.0137
    off = np.stack([-d[:, 1], d[:, 0]], axis=1) * (np.minimum(1e-6, size * 1e-3) / size)[:, None]
    points, at = np.concatenate([middle + off, middle - off]), np.tile(pair, 2)
    core, full = (K._Rings([(a[z], b[z]) for a, b in pairs]) for z in (0, 1))
    within = []
    for side in (0, 1):
        inner, wide = (r.inside(points, at, side) if r.most else np.zeros(len(points), dtype=bool) for r in (core, full))
        within.append({"core": inner, "band": wide & ~inner, "out": ~wide})
    for bit, x, y in CELLS:
        hit = within[0][x] & within[1][y]
        out += bit * (np.bincount(at[hit], minlength=len(pairs)) > 0)
    return out


def known_bits(names: list, region, margin: float) -> list[int]:
    """The nine bits of pairs of regions by their names; ``region`` gives those of a place."""

    def by_move(at: list[int]) -> list[int]:
        given = [region(i) for i in at]

        def fresh(new: list[int]) -> list[int]:
            traced = [_ZONES.one((margin, region_key(r)), lambda r=r: zones(r, margin)) for k in new for r in given[k]]
            return relate_zones(list(zip(traced[::2], traced[1::2], strict=True))).tolist()

        return _MOVED.many([(margin, k) for k in moved_pairs(given)[0]], fresh)

    return _BITS.many([(margin, n) for n in names], by_move)


def relations_within(pairs: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """``keys`` with ``bits`` (nine) of two regions a_ops, a_n, a_xy and b_... whose boundaries are
    as wide as the margin on both sides. A task keeps the zones of regions it has met."""
    ship(pairs.sparkSession)

    def run(batches):
        for b in batches:
            got = known_bits(*pair_names(b), margin)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(got, type=pa.int32())], names=[*keys, "bits"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", bits int")
