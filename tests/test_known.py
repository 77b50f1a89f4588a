"""Work that repeats is done once a worker, and spread over all cores."""

import numpy as np
import pandas as pd

from slicetopo.operators import known, shapes, structures

BOX = np.array([[2.0, 2.0], [2.0, 0.0], [0.0, 0.0], [0.0, 2.0]])


def test_a_memory_is_bounded_and_asks_for_what_is_new():
    asked, memory = [], known.Known(3)

    def answer(keys):
        return memory.many(keys, lambda at: [asked.append(keys[i]) or keys[i] * 10 for i in at])

    assert answer([1, 2, 1]) == [10, 20, 10]
    assert answer([2, 3, 1]) == [20, 30, 10] and asked == [1, 2, 3] or asked == [2, 1, 3]
    assert answer([4, 1]) == [40, 10] and len(memory.of) == 2


def test_equal_structures_are_built_once(monkeypatch):
    calls, build = [], structures.build
    monkeypatch.setattr(structures, "build", lambda *a: calls.append(1) or build(*a))
    one = lambda s, r: structures._nodes(pd.DataFrame({"set_id": s, "roi": r, "z": [0.25, 1.25], "xy": [BOX.ravel()] * 2, "zs": [np.array([0.25, 1.25])] * 2}))
    a, b = one("p", 1), one("q", 7)
    assert len(calls) == 1
    assert set(a["set_id"]) == {"p"} and set(b["set_id"]) == {"q"} and set(b["roi"]) == {7}
    assert a.drop(columns=["set_id", "roi"]).equals(b.drop(columns=["set_id", "roi"]))


def test_measures_of_pairs_that_differ_by_a_move_and_of_others():
    of = lambda x, y: ([("+", BOX + x)], [("+", BOX + y)])
    got = shapes._measures([of(0.0, 1.0), of(5.0, 6.0), of(0.5, 1.5), of(0.0, 7.0)])
    areas = [{name: round(a, 6) for name, *_, a in g} for g in got]
    assert areas[0] == areas[1] == areas[2] == {"a_only": 3.0, "b_only": 3.0, "both": 1.0, "either": 7.0, "one": 6.0}
    assert areas[3] == {"a_only": 4.0, "b_only": 4.0, "either": 8.0, "one": 8.0}


def test_small_geometry_is_spread_over_all_cores(spark):
    rows = [(str(s), r, float(z), [(float(x), float(y)) for x, y in BOX]) for s in range(4) for r in range(3) for z in range(2)]
    contours = spark.createDataFrame(rows, "set_id string, roi int, z double, points array<struct<x:double,y:double>>")
    tasks = 2 * spark.sparkContext.defaultParallelism
    own = structures.nodes(contours)
    assert own.where("problem is null").rdd.getNumPartitions() >= tasks
    assert structures.region_slices(own).rdd.getNumPartitions() >= tasks
