"""Volumes with known relations, end to end; region counts and hole types."""

import pytest
from pyspark.sql import functions as F

from slicetopo.operators import structures as S
from slicetopo.sources import generators as G

#: name: (parts of ROI 1, parts of ROI 2, relation)
SCENES = {
    "cube in cube": (lambda m: [m.box(6, 6, 6, 1)], lambda m: [m.box(2, 2, 2, 1)], "CONTAINS"),
    "cylinder in cylinder": (lambda m: [m.cyl(5, 8, 1)], lambda m: [m.cyl(3, 6, 1)], "CONTAINS"),
    "inside the hollow": (lambda m: [m.cyl(6, 10, 1), m.cyl(5, 8, 1)], lambda m: [m.cyl(3, 6, 1)], "SURROUNDS"),
    "inside the open tube": (lambda m: [m.cyl(6, 10, 1), m.cyl(5, 10, 1)], lambda m: [m.cyl(3, 6, 1)], "SHELTERS"),
    "side by side": (lambda m: [m.box(2, 2, 2, 1, x=-3)], lambda m: [m.box(2, 2, 2, 1, x=3)], "DISJOINT"),
    "longer than the tube": (lambda m: [m.cyl(6, 10, 1), m.cyl(5, 10, 1)], lambda m: [m.cyl(3, 12, 1)], "DISJOINT"),
    "touching sides": (lambda m: [m.box(2, 2, 2, 1, x=-1)], lambda m: [m.box(2, 2, 2, 1, x=1)], "BORDERS"),
    "touching along z": (lambda m: [m.cyl(3, 8, 1)], lambda m: [m.cyl(1, 2, 1, z=6)], "BORDERS"),
    "apart along z": (lambda m: [m.cyl(3, 8, 1)], lambda m: [m.cyl(1, 2, 1, z=7)], "DISJOINT"),
    "wall of a hollow": (lambda m: [m.box(6, 6, 6, 1), m.box(4, 4, 4, 1)], lambda m: [m.box(4, 4, 4, 1)], "CONFINES"),
    "half of a cube": (lambda m: [m.box(6, 6, 6, 1)], lambda m: [m.box(6, 3, 6, 1, y=1.5)], "PARTITIONED"),
    "shifted": (lambda m: [m.box(6, 6, 6, 1)], lambda m: [m.box(6, 6, 6, 1, y=2)], "OVERLAPS"),
    "the same": (lambda m: [m.box(6, 6, 6, 1)], lambda m: [m.box(6, 6, 6, 1)], "EQUAL"),
}


class Maker:
    def __init__(self, spark, set_id):
        self.spark, self.set_id, self.roi = spark, set_id, 1

    def box(self, w, d, h, s, **at):
        return G.cuboid(self.spark, self.set_id, self.roi, w, d, h, s, **at)

    def cyl(self, r, length, s, **at):
        return G.vertical_cylinder(self.spark, self.set_id, self.roi, r, length, s, **at)


@pytest.fixture(scope="module")
def scene_contours(spark):
    out = None
    for name, (one, two, _) in SCENES.items():
        m = Maker(spark, name)
        parts = one(m)
        m.roi = 2
        parts += two(m)
        for p in parts:
            out = p if out is None else out.unionByName(p)
    rows = out.collect()
    df = spark.createDataFrame(rows, G.CONTOURS)
    # A body on every slice, and one beyond each end.
    ends = df.groupBy("set_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    zs = F.transform(F.sequence(F.lit(-1), (F.col("hi") - F.col("lo")).cast("int") + 1), lambda i: F.col("lo") + i)
    body = ends.select("set_id", F.explode(zs).alias("z")).select("set_id", F.lit(0).cast("int").alias("roi"), "z", G.box(F.lit(100.0), F.lit(100.0)).alias("points"))
    return df.unionByName(body).cache()


def test_relations_of_scenes(spark, scene_contours):
    slices = S.region_slices(scene_contours).cache()
    order = scene_contours.select("set_id", "roi").distinct().withColumn("place", F.col("roi"))
    got = {(r.set_id, r.roi_a, r.roi_b): r.relation for r in S.relations(slices, order).collect()}
    wrong = {n: got[n, 1, 2] for n, (_, _, want) in SCENES.items() if got[n, 1, 2] != want}
    assert not wrong, wrong
    assert {got[n, 0, 1] for n in SCENES} == {"CONTAINS"}


def test_contour_report(spark):
    at = lambda roi, z, w, x=0.0: (("s", roi, float(z), [(x + sx * w / 2, sy * w / 2) for sx, sy in ((1, 1), (1, -1), (-1, -1), (-1, 1))]))
    rows = [at(0, z, 50) for z in range(0, 6)]
    rows += [at(1, z, 6) for z in range(1, 5)] + [at(1, z, 2) for z in range(2, 4)]
    rows += [at(2, z, 6) for z in range(1, 5)] + [at(2, z, 2) for z in range(1, 5)]
    rows += [at(3, z, 2, x) for z in (1, 2) for x in (-5.0, 5.0)] + [at(3, 3, 14)]
    df = spark.createDataFrame([(s, r, z, [{"x": a, "y": b} for a, b in p]) for s, r, z, p in rows], G.CONTOURS)
    out = S.contour_report(df).collect()
    kinds = lambda roi: {r.hole_type for r in out if r.roi == roi and r.is_hole}
    assert kinds(1) == {"Closed"} and kinds(2) == {"Open"} and kinds(3) == set()
    assert {r.region for r in out if r.roi == 3} == {"3A"}
    assert sorted({r.z for r in out if r.roi == 1 and r.is_boundary and not r.is_hole}) == [0.5, 4.5]
    vol = {r.roi: r for r in S.volumes(df).collect()}
    assert vol[1].place > vol[0].place and abs(vol[1].physical - (36 * 4 - 4 * 2)) < 1e-6 and abs(vol[1].exterior - 36 * 4) < 1e-6
    assert abs(vol[2].exterior - (36 * 4 - 4 * 4)) < 1e-6 and abs(vol[2].hull - 36 * 4) < 1e-6


def square(x0, x1, y0, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def test_bad_rings_are_set_aside(spark):
    """Nothing fails and nothing vanishes: each bad ring has a reason, the others count."""
    good = [("s", 1, float(z), square(0, 4, 0, 4)) for z in range(3)]
    bow = [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 2.0, "y": 0.0}, {"x": 0.0, "y": 2.0}]
    bad = [("s", 1, 1.0, [{"x": 0.0, "y": 0.0}]), ("s", 1, None, square(0, 1, 0, 1)), ("s", 1, 1.0, None), ("s", 1, 1.0, [{"x": None, "y": 0.0}] * 3), ("s", 1, 1.0, bow), ("s", 1, 2.0, square(3, 5, 3, 4)), ("t", 2, float("nan"), square(0, 1, 0, 1))]
    df = spark.createDataFrame([*good, *bad], G.CONTOURS)
    assert [bool(r.problem) for r in S.check_contours(df).collect()].count(True) == 5
    own = S.nodes(df).cache()
    lost = S.quarantined(own).collect()
    assert len(lost) == len(bad) and {r.problem for r in lost} == {"fewer than three points", "no slice position", "missing coordinate", "a ring that crosses itself or has no area", "a ring that overlaps another of its structure"}
    clean = S.nodes(spark.createDataFrame(good, G.CONTOURS)).cache()
    for f in (S.contour_report, S.volumes, S.region_slices, S.regions):
        assert sorted(map(str, f(own).collect())) == sorted(map(str, f(clean).collect()))
    assert S.volumes(spark.createDataFrame(bad[:5], G.CONTOURS)).count() == 0


def test_the_end_of_a_hole_is_a_boundary_inside_its_structure(spark):
    """Two holes that end where their structure goes on: both ends are walls, and what lies in
    one of them up to its end confines it."""
    rows = [("s", 0, float(z), square(-9, 9, -9, 9)) for z in range(-1, 7)]
    rows += [("s", 1, float(z), square(-6, 6, -3, 3)) for z in range(6)]
    rows += [("s", 1, float(z), square(*x, -1, 1)) for z in (2, 3) for x in ((-4, -2), (2, 5))]
    rows += [("s", 2, float(z), square(2, 5, -1, 1)) for z in (2, 3)] + [("s", 3, float(z), square(-4, -2, -1, 1)) for z in (2, 3)]
    own = S.nodes(spark.createDataFrame(rows, G.CONTOURS)).cache()
    slices = S.region_slices(own).cache()
    from slicetopo.operators import kernel as K

    cap = [r for r in slices.where("roi = 1 and z in (1.5, 3.5)").collect()]
    assert len(cap) == 2 and all(abs(K.area(S.geometry(r.asDict(), "boundary")) - (4 + 6)) < 1e-9 for r in cap)
    order = own.select("set_id", "roi").distinct().withColumn("place", F.col("roi"))
    got = {(r.roi_a, r.roi_b): r.relation for r in S.relations(slices, order).collect()}
    assert got[1, 2] == got[1, 3] == "CONFINES" and got[2, 3] == "DISJOINT"


def test_structures_are_added_to_a_set_that_is_done(spark, scene_contours):
    part = scene_contours.where("set_id in ('shifted', 'cube in cube')").cache()
    order = part.select("set_id", "roi").distinct().withColumn("place", F.col("roi"))
    slices = S.region_slices(part).cache()
    whole = {(r.set_id, r.roi_a, r.roi_b): (r.bits, r.relation) for r in S.relations(slices, order).collect()}
    done = S.relations(slices.where("roi <> 2"), order.where("roi <> 2"))
    got = {(r.set_id, r.roi_a, r.roi_b): (r.bits, r.relation) for r in S.add_structures(done, slices, order, [2]).collect()}
    assert got == whole
    assert [r.complete for r in S.is_complete(done, order).collect()] == [False] * 2
    turned = order.withColumn("place", -F.col("roi"))
    back = {(r.roi_a, r.roi_b) for r in S.add_structures(done, slices, turned, [2]).collect()}
    assert back == {(1, 0), (2, 0), (2, 1)}
    with pytest.raises(ValueError):
        S.volumes(part, by=("weight",))


def test_sets_that_arrive_in_several_batches(spark, tmp_path):
    from slicetopo.operators import boxes as B
    from slicetopo.streaming import ingest

    supplier = spark.createDataFrame([(k,) for k in range(90)], "s_suppkey long")
    for i, part in enumerate(("s_suppkey % 3 = 0", "s_suppkey % 3 = 1", "s_suppkey % 3 = 2 or s_suppkey = 0")):
        supplier.where(part).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    import pathlib
    import shutil

    (tmp_path / "all").mkdir()
    for i in range(3):
        shutil.copy(next(pathlib.Path(tmp_path, f"in{i}").glob("*.parquet")), tmp_path / "all" / f"part-{i}.parquet")
    got = ingest.relations_by_stream(spark, str(tmp_path / "all"), "part-*.parquet", files_at_once=1)
    want = B.pair_relations(B.solid_boxes(supplier))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_metrics_by_configuration_and_surfaces(spark, scene_contours):
    from slicetopo.operators import metrics as M

    part = scene_contours.where("set_id in ('touching sides', 'side by side', 'cube in cube', 'half of a cube') and roi > 0").cache()
    own = S.nodes(part).cache()
    slices = S.region_slices(own).cache()
    rel = S.relations(slices, S.volumes(own)).cache()
    kinds = {r.set_id: r.relation for r in rel.collect()}
    assert kinds == {"touching sides": "BORDERS", "side by side": "DISJOINT", "cube in cube": "CONTAINS", "half of a cube": "PARTITIONED"}
    wall = M.calculate("surface_overlap", slices, rel).first()
    assert (wall.set_id, wall.common, wall.share_a, wall.share_b) == ("touching sides", 6.0, 0.25, 0.25)
    far = {r.set_id: r for r in M.calculate("minimum_distance", slices, rel).collect()}
    assert far["side by side"].minimum_distance == 4.0 and far["touching sides"].minimum_distance == 0.0 and far["side by side"].region_b == "2A"
    assert {r.set_id: round(r.distance, 6) for r in M.centroid_distance(own, rel).collect()} == {"touching sides": 2.0, "side by side": 6.0, "cube in cube": 0.0, "half of a cube": 1.5}
    most = {r.set_id: r for r in M.calculate("maximum_margin", slices, rel).collect()}
    assert most["cube in cube"].maximum == 2.83 and most["half of a cube"].maximum == 0.0
    out = M.calculate_all(M.Config(categories=("margins",), orientation="FFS", not_applicable="zero"), slices, rel)["minimum_margins"]
    got = {r.set_id: r.asDict() for r in out.collect()}
    assert got["cube in cube"]["L"] == got["cube in cube"]["R"] == 2.0 and got["side by side"]["L"] == 0.0 and len(got) == 4


def test_new_slices_and_emptiness(spark):
    assert S.new_slice([1.0, 2.0]) == 1.5 and S.new_slice([1.12345, 1.12355], 1e-4) == 1.1235
    with pytest.raises(ValueError):
        S.new_slice([1.12345, 1.12355], 1.0)
    rows = spark.createDataFrame([("+", ""), ("", "+-"), ("", ""), (None, None), ("-", None)], "region_ops string, boundary_ops string")
    assert [r.is_empty for r in S.empty(rows).collect()] == [False, False, True, True, True]
    ring = spark.range(1).select(G.circle_at(2.0, [-2.0, 0.0, 2.0, 3.0], y=1.0).alias("p")).first().p
    assert [(p.x, p.y) for p in ring] == [(-2.0, 1.01), (0.0, 3.0), (2.0, 1.01), (3.0, 1.01), (2.0, 0.99), (0.0, -1.0), (-2.0, 0.99)]


def test_regions_of_a_slice_can_be_selected(spark, scene_contours):
    from slicetopo.operators import kernel as K

    cut = S.region_slices(scene_contours.where("set_id = 'wall of a hollow' and roi = 1")).cache()
    area = lambda what: sum(K.area(K.unpack(r.ops, r.n, r.xy)) for r in S.select(cut, what).collect())
    whole = sum(K.area(K.union(S.geometry(r.asDict(), "region"), S.geometry(r.asDict(), "boundary"))) for r in cut.collect())
    assert area("all") == pytest.approx(whole) and area("boundary") > 0
    assert area("contour") < area("exterior") <= area("hull") + 1e-6
    with pytest.raises(ValueError, match="none of"):
        S.select(cut, "outline")
