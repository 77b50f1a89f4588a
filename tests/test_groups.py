"""Groups of rows in Arrow batches: many of them in a call, none cut in two."""

import numpy as np
import pyarrow as pa

from slicetopo.operators import groups, structures

BOX = [2.0, 2.0, 2.0, 0.0, 0.0, 0.0, 0.0, 2.0]


def test_groups_are_whole_and_many_in_a_call(spark):
    def counted(t, starts):
        ends = np.append(starts[1:], t.num_rows)
        v = t["v"].to_numpy()
        sums = [int(v[i:j].sum()) if list(v[i:j]) == sorted(v[i:j]) else -1 for i, j in zip(starts, ends, strict=True)]
        yield pa.table([t["k"].take(pa.array(starts)), ends - starts, sums, np.full(len(starts), len(starts))], names=["k", "n", "total", "in_call"])

    rows = [(None if k == 7 else f"k{k}", v) for k in range(300) for v in range(k % 9 + 1)]
    df = spark.createDataFrame(rows[::-1], "k string, v long")
    for size in ("4", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = groups.in_groups(df, ("k",), ("v",), counted, "k string, n long, total long, in_call long").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r.k or "", r.n, r.total) for r in got) == sorted(("" if k == 7 else f"k{k}", k % 9 + 1, sum(range(k % 9 + 1))) for k in range(300))
    assert max(r.in_call for r in got) > 1


def test_keys_are_exact():
    t = pa.table({"a": pa.array([[1.0, 2.0], [], [1.0], [2.0]]), "s": ["+", None, "", "+"]})
    a, b, c = (groups.names_of(t.slice(i, n), np.array([0]), ("a",)) for i, n in ((0, 2), (2, 2), (0, 1)))
    assert len({a[0], b[0], c[0]}) == 3
    assert len(set(groups.names_of(t, np.arange(4), ("s",)))) == 3


def test_structures_of_a_batch_that_are_alike_are_built_once(monkeypatch):
    calls, build = [], structures.build
    monkeypatch.setattr(structures, "build", lambda *a: calls.append(1) or build(*a))
    zs, rings = [0.125, 1.125, 2.125], [[x + 0.0625 for x in BOX]] * 3
    t = pa.table({"set_id": np.repeat([f"s{i}" for i in range(50)], 3), "roi": pa.array([9] * 150, type=pa.int32()), "z": zs * 50, "xy": rings * 50, "zs": [zs] * 150})
    (got,) = structures._node_rows(t, np.arange(0, 150, 3))
    assert len(calls) == 1 and got.num_rows == 250
    assert got.group_by("set_id").aggregate([("node", "count")])["node_count"].to_pylist() == [5] * 50


def test_pairs_of_a_slice_over_several_tables(spark, monkeypatch):
    shape = lambda r, place: {"set_id": "p", "roi": r, "zk": 0, "place": place, "is_boundary": False, "is_interpolated": False, "has_region": True, **{f"{g}_{c}": v for g in structures.GEOMETRIES for c, v in (("ops", "" if g == "boundary" else "+"), ("n", [] if g == "boundary" else [4]), ("xy", [] if g == "boundary" else [x + r for x in BOX]))}}
    t = pa.Table.from_pylist([shape(r, r + 1) for r in range(5)])
    one = pa.concat_tables(structures._slice_pair_rows(t, np.array([0])))
    monkeypatch.setattr(structures, "AT_ONCE", 3)
    some = list(structures._slice_pair_rows(t, np.array([0])))
    assert one.num_rows == 10 and len(some) > 1 and pa.concat_tables(some).to_pylist() == one.to_pylist()
