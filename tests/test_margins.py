"""Margins of structures with several regions, against values worked out by hand."""

import numpy as np

from slicetopo.operators import kernel as K
from slicetopo.operators import metrics, structures
from slicetopo.sources import generators as G


def cut_and_relate(spark, parts):
    contours = spark.createDataFrame(parts.collect(), G.CONTOURS)
    cut = structures.region_slices(contours).cache()
    return cut, structures.relations(cut, structures.volumes(contours)).cache()


def test_rays_start_at_the_centroid_of_all_regions(spark):
    # A is 20 x 20 about 0; B has a square of 4 at x = -4 and one of 2 at x = 8. In "t" the
    # smaller one ends sooner.
    part = lambda s, height: G.cuboid(spark, s, 1, 20, 20, 8, 1).unionByName(G.cuboid(spark, s, 2, 4, 4, 4, 1, x=-4.0)).unionByName(G.cuboid(spark, s, 2, 2, 2, height, 1, x=8.0))
    cut, rel = cut_and_relate(spark, part("s", 4).unionByName(part("t", 2)))
    assert {r.relation for r in rel.collect()} == {"CONTAINS"}
    got = {r.set_id: r for r in metrics.calculate("minimum_margins", cut, rel).collect()}
    # The centroid is at x = (16 * -4 + 4 * 8) / 20 = -1.6, beside both squares: 8.6 to the
    # smaller and 1 behind it, 0.4 to the larger and 4 behind it, nothing above and below.
    r = got["s"]
    assert (r.x_plus, r.x_minus, r.y_plus, r.y_minus, r.minimum) == (9.6, 4.4, 10.0, 10.0, 1.0)
    pairs = {(r.set_id, r.region_b): r for r in metrics.region_margins(cut, rel).collect()}
    assert set(pairs) == {(s, b) for s in "st" for b in ("2A", "2B")}
    big, small = sorted((pairs["t", b] for b in ("2A", "2B")), key=lambda r: r.z_plus)
    # Where the larger is alone, its own centroid counts, for its pair only.
    assert (big.x_plus, big.x_minus, big.y_plus) == (9.6, 4.0, 8.0) and (small.x_plus, small.x_minus, small.y_plus) == (9.6, 4.4, 10.0)
    assert big.z_plus < small.z_plus
    for s, r in got.items():
        for c in (*metrics.DIRECTIONS, "minimum"):
            assert r[c] == min(pairs[s, b][c] for b in ("2A", "2B"))
        assert r[r.worst_direction] == min(r[c] for c in metrics.DIRECTIONS)
        assert r.region_a == "1A" and pairs[s, r.region_b].minimum == r.minimum


def test_centroid_of_a_region_with_a_hole():
    box = lambda x0, x1: K.ring_of([(x0, 0), (x1, 0), (x1, 2), (x0, 2)])
    assert np.allclose(K.region_centroid([("+", box(0, 4)), ("-", box(0, 1)), ("+", box(10, 11))]), ((3 * 2.5 + 10.5) / 4, 1))
    assert np.isnan(K.region_centroid([])).all()
