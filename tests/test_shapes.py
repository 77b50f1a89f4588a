"""Shapes by half-edges, half-way polygons, and structures with holes and several regions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicetopo.operators import interpolation as I
from slicetopo.operators import kernel as K
from slicetopo.operators import shapes as S
from slicetopo.operators import structures
from slicetopo.sources import frames


def box(x0, x1, y0, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], dtype=float)


def sizes(polygons):
    return sorted((len(p[0]), [len(h) for h in p[1]], round(S.area(p), 6)) for p in polygons)


@pytest.mark.parametrize(
    ("a", "b", "part", "want"),
    [
        ((0, 4, 0, 4), (1, 3, 1, 3), "a_only", [(4, [4], 12)]),
        ((0, 4, 0, 4), (2, 6, 2, 6), "one", [(6, [], 12), (6, [], 12)]),
        ((0, 4, 0, 4), (2, 6, 2, 6), "either", [(8, [], 28)]),
        ((0, 4, 0, 4), (1, 3, -1, 5), "a_only", [(4, [], 4), (4, [], 4)]),
        ((0, 4, 0, 4), (4, 6, 0, 4), "either", [(4, [], 24)]),
        ((0, 4, 0, 4), (4, 6, 4, 6), "either", [(4, [], 4), (4, [], 16)]),
        ((0, 4, 0, 4), (0, 4, 0, 4), "a_only", []),
    ],
)
def test_parts_of_boxes(a, b, part, want):
    got = S.overlay_many([([("+", box(*a))], [("+", box(*b))])])[0]
    assert sizes(got[part]) == want


def test_areas_of_parts_agree_with_the_kernel():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = ([("+", c + rng.uniform(1, 4) * np.column_stack([np.cos(t), np.sin(t)]))] for c, t in ((rng.uniform(0, 3, 2), np.sort(rng.uniform(0, 2 * math.pi, 9))) for _ in range(2)))
        got = S.overlay_many([(a, b)])[0]
        for name, keep in S.PARTS.items():
            assert sum(map(S.area, got[name])) == pytest.approx(K.combined_area([a, b], keep), abs=1e-6)


def test_holes_islands_and_bands():
    frame = [("+", box(0, 10, 0, 10)), ("-", box(2, 8, 2, 8)), ("+", box(4, 6, 4, 6))]
    assert sizes(S.shapes_of([frame], lambda x: x)) == [(4, [], 4), (4, [4], 64)]
    band = S.shapes_of([K.band([("+", box(0, 10, 0, 10))], 0.5)], lambda x: x)
    assert len(band) == 1 and len(band[0][1]) == 1
    # Inside lie straight strips, outside quarters of a disk at the corners.
    assert S.area(band[0]) == pytest.approx(100 - 81 + 4 * 10 * 0.5 + math.pi * 0.25, abs=0.01)


def test_third_structure(spark):
    rows = [(1, "+", [4], box(0, 4, 0, 4).ravel().tolist(), "+", [4], box(2, 6, 0, 4).ravel().tolist(), "+", [4], box(3, 9, 0, 4).ravel().tolist())]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{x}_ops string, {x}_n array<int>, {x}_xy array<double>" for x in "abc"))
    got = {r.part: r.area for r in S.measures(S.overlays(df, ["id"], margin=0.2), ["id"]).collect()}
    assert got["both:common"] == pytest.approx(4) and got["both:only"] == pytest.approx(4) and got["both:c_only"] == pytest.approx(20)
    assert got["either:common"] == pytest.approx(12) and got["one:common"] == pytest.approx(8) and got["a_only:c_only"] == pytest.approx(24) and got["band_a"] > 1.5


def test_repair_keeps_the_largest_face():
    bow = np.array([(0, 0), (6, 6), (6, 0), (0, 2)], dtype=float)
    assert not K.is_simple(bow)
    fixed = S.repaired(bow)
    assert K.is_simple(fixed) and abs(K.ring_area(fixed)) == pytest.approx(13.5)
    assert len(S.repaired(np.array([(0, 0), (1, 1), (2, 2)], dtype=float))) == 0


def test_half_way():
    assert np.allclose(np.sort(I.half_way(box(0, 4, 0, 4), box(2, 4, 2, 4)), axis=0), np.sort(box(1, 4, 1, 4), axis=0))
    circle = lambda r, n, t0=0.0: r * np.column_stack([np.cos(t0 + np.arange(n) * 2 * math.pi / n), np.sin(t0 + np.arange(n) * 2 * math.pi / n)])
    ring = I.by_order(circle(2, 40), circle(4, 40, 1.3)[::-1])
    assert len(ring) >= I.LEAST_POINTS and np.allclose(np.hypot(*ring.T), 3, atol=0.06)


def test_holes_between():
    shell, hole = box(0, 10, 0, 10), box(4, 6, 4, 6)
    alone = I.polygon_between((shell, [hole]), (shell, []))
    assert S.area((alone[0], [h for h in alone[1]])) == pytest.approx(99) or abs(K.ring_area(alone[1][0])) == pytest.approx(1)
    both = I.polygon_between((shell, [hole]), (shell, [box(4, 6, 4, 6)]))
    assert abs(K.ring_area(both[1][0])) == pytest.approx(4)
    assert I.polygon_between((shell, [hole]), None) == (shell, [hole])
    small, none = I.polygon_between((K.NO_RING, []), (shell, [hole]))
    assert abs(K.ring_area(small)) == pytest.approx(25) and none == []
    with pytest.raises(ValueError, match="neither"):
        I.polygon_between((K.NO_RING, []), None)
    # A hole that cuts the polygon in two leaves the larger part.
    cut, _ = I.polygon_between((box(0, 10, 0, 4), [box(6, 8, -6, 10)]), (box(0, 10, 0, 4), []))
    assert abs(K.ring_area(cut)) == pytest.approx(26)


def test_frames_have_holes_islands_and_regions(spark):
    suppliers = spark.range(48).select(F.col("id").alias("s_suppkey"))
    nodes = structures.nodes(frames.contours(suppliers)).where("not is_made").cache()
    kinds = {(r.is_hole, r.hole_type) for r in nodes.select("is_hole", "hole_type").distinct().collect()}
    assert kinds == {(False, "None"), (True, "Closed"), (True, "Open")}
    assert nodes.where("label = 'B'").count() > 0
    got = structures.relations(structures.region_slices(nodes), structures.volumes(nodes))
    found = {r.relation for r in got.select("relation").distinct().collect()}
    assert {"SURROUNDS", "CONFINES", "SHELTERS", "CONTAINS", "PARTITIONED", "EQUAL", "BORDERS", "OVERLAPS", "DISJOINT"} <= found


def test_zones_in_bulk_agree_with_the_kernel(spark):
    import random

    from slicetopo.operators import tolerance

    rng = random.Random(2)
    made = lambda: [("+", box(x := rng.randrange(7), x + rng.randrange(1, 6), y := rng.randrange(7), y + rng.randrange(1, 6)))]
    pairs = [(made(), made()) for _ in range(40)] + [([("+", box(0, 9, 0, 9)), ("-", box(3, 6, 3, 6))], made()) for _ in range(15)]
    for margin in (0.3, 1.1):
        got = tolerance.relate_zones([tuple(tolerance.zones(r, margin) for r in p) for p in pairs])
        assert got.tolist() == [K.relate_within(a, b, margin) for a, b in pairs]
    rows = [(i, *K.pack(a), *K.pack(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame([(i, o, n, list(map(float, xy)), p, m, list(map(float, uv))) for i, o, n, xy, p, m, uv in rows], "id int, a_ops string, a_n array<int>, a_xy array<double>, b_ops string, b_n array<int>, b_xy array<double>")
    assert [r.bits for r in sorted(tolerance.relations_within(df, ["id"], 1.1).collect())] == got.tolist()
