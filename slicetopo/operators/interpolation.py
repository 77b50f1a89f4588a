"""The polygon half-way between two: outer rings by nearest points, or point by point along
both rings where that crosses itself; holes by the hole they overlap, or drawn in; repaired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernel as K
from . import shapes as S

#: Points that rings have at least when they are followed point by point.
LEAST_POINTS = 24

Polygon = tuple[np.ndarray, list[np.ndarray]]


def resampled(ring: np.ndarray, n: int) -> np.ndarray:
    """``n`` points at equal distances along a ring, from its first point."""
    closed = np.concatenate([ring, ring[:1]])
    along = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(closed, axis=0).T))])
    at = np.arange(n) * (along[-1] / n)
    return np.column_stack([np.interp(at, along, closed[:, c]) for c in (0, 1)])


def by_order(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Both rings with as many points, each half-way to its partner; of all beginnings of the
    second ring and both its directions, those of the least sum of distances."""
    n = max(len(one) + 1, len(two) + 1, LEAST_POINTS)
    p, best = resampled(one, n), None
    turns = (np.arange(n)[:, None] + np.arange(n)[None]) % n
    for q in (resampled(two, n), resampled(two[::-1], n)):
        far = np.hypot(*np.moveaxis(p[:, None] - q[None], 2, 0))
        sums = far[np.arange(n)[None], turns].sum(axis=1)
        k = int(sums.argmin())
        if best is None or sums[k] < best[0] - K.SNAP:
            best = sums[k], q[turns[k]]
    return (p + best[1]) / 2


def half_way(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The ring half-way between two outer rings; the first one where nothing else holds."""
    p, q = K.aligned(one, two)
    for ring in (K.by_nearest(p, q), by_order(p, q)):
        if K.is_simple(ring):
            return ring
    ring = S.repaired(by_order(p, q))
    return ring if len(ring) else one


def matched(one: list[np.ndarray], two: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Holes of both with their partners: those that overlap; without one, None."""
    met = [(i, j) for i, p in enumerate(one) for j, q in enumerate(two) if K.relate([("+", p)], [("+", q)]) & K.II]
    alone = [(p, None) for i, p in enumerate(one) if i not in {i for i, _ in met}]
    return [(one[i], two[j]) for i, j in met] + alone + [(q, None) for j, q in enumerate(two) if j not in {j for _, j in met}]


def polygon_between(one: Polygon, two: Polygon | None) -> Polygon:
    """The largest polygon of what is half-way: without a second one the first; without a
    first one the second in half its size. A hole without a partner is drawn half-way to its
    centre."""
    if two is None:
        if not len(one[0]):
            raise ValueError("neither polygon has points")
        return one
    if not len(one[0]):
        box = (two[0].min(axis=0) + two[0].max(axis=0)) / 2
        return (two[0] + box) / 2, []
    shell = half_way(one[0], two[0])
    holes = [K.shrink(p) if q is None else S.repaired(K.by_nearest(p, q)) for p, q in matched(one[1], two[1])]
    holes = [h for h in holes if len(h) >= 3]
    if not holes:
        return shell, []
    found = S.shapes_of([[("+", shell), *(("-", h) for h in holes)]], lambda x: x)
    return max(found, key=S.area) if found else (one[0], [])


def between(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with (shell, holes, area) of the polygon half-way between those of a row:
    one_shell, one_holes, two_shell and two_holes, as flat coordinates. A row of which both
    have no points gives none."""
    ship(pairs.sparkSession)
    flat = lambda r: np.asarray(r or [], dtype=float).reshape(-1, 2)

    def run(batches):
        for b in batches:
            index, shells, holes, sizes = [], [], [], []
            for i, r in enumerate(b.to_pylist()):
                one, two = ((flat(r[f"{x}_shell"]), [flat(h) for h in r[f"{x}_holes"] or []]) for x in ("one", "two"))
                if len(one[0]) or len(two[0]):
                    got = polygon_between(one, two if len(two[0]) else None)
                    index.append(i)
                    shells.append(got[0].ravel().tolist())
                    holes.append([h.ravel().tolist() for h in got[1]])
                    sizes.append(abs(K.ring_area(got[0])) - sum(abs(K.ring_area(h)) for h in got[1]))
            kept = [b.column(c).take(pa.array(index, type=pa.int64())) for c in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shells, type=pa.list_(pa.float64())), pa.array(holes, type=pa.list_(pa.list_(pa.float64()))), pa.array(sizes, type=pa.float64())], names=[*keys, "shell", "holes", "area"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", shell array<double>, holes array<array<double>>, area double")


def next_polygons(polygons: DataFrame) -> DataFrame:
    """Rows for :func:`between` from (set_id, roi, z, shell, holes): each polygon with the one
    on the structure's next slice; z is half-way."""
    from pyspark.sql import Window

    w = Window.partitionBy("set_id", "roi").orderBy("z")
    ahead = polygons.select("set_id", "roi", "z", *[F.col(c).alias(f"one_{c}") for c in ("shell", "holes")], *[F.lead(c).over(w).alias(f"two_{c}") for c in ("shell", "holes")], F.lead("z").over(w).alias("_z"))
    return ahead.where("_z is not null").withColumn("z", (F.col("z") + F.col("_z")) / 2).drop("_z")
