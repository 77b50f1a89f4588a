"""Tiles of pairs in Arrow batches: equal structures of many sets are asked for once."""

import numpy as np
import pyarrow as pa

from slicetopo.operators import metrics

BOX = [2.0, 2.0, 2.0, 0.0, 0.0, 0.0, 0.0, 2.0]
KINDS = pa.schema([("set_id", pa.string()), ("row_tile", pa.int64()), ("column_tile", pa.int64()), ("roi", pa.int32()), ("roi_b", pa.int32()), ("zk", pa.int64()), ("z", pa.float64()), ("labels", pa.list_(pa.string())), *((f"{g}_{c}", t) for g in ("region", "boundary") for c, t in (("ops", pa.string()), ("n", pa.list_(pa.int32())), ("xy", pa.list_(pa.float64()))))])


def test_pairs_of_equal_structures_are_asked_for_once():
    cut = lambda s, r, x: {"set_id": s, "row_tile": 0, "column_tile": 0, "roi": r, "zk": 5000, "z": 0.5, "labels": [f"{r}A"], "region_ops": "+", "region_n": [4], "region_xy": [v + x for v in BOX], "boundary_ops": "", "boundary_n": [], "boundary_xy": []}
    pair = lambda s, a, b: {"set_id": s, "row_tile": 0, "column_tile": 0, "roi": a, "roi_b": b}
    rows, starts = [], []
    for k in range(30):
        starts.append(len(rows))
        # The third structure has no slices.
        rows += [cut(f"s{k}", 1, 0.0), cut(f"s{k}", 2, 1.0), pair(f"s{k}", 1, 2), pair(f"s{k}", 1, 3)]
    asked = []

    def areas_once(cuts, todo):
        asked.extend(todo)
        return metrics._areas(cuts, todo)

    schema = "set_id string, roi_a int, roi_b int, z double, common double"
    (got,) = metrics._tile_rows(areas_once, schema, pa.Table.from_pylist(rows, schema=KINDS), np.array(starts))
    assert len(asked) == 2
    assert [tuple(r.values()) for r in got.to_pylist()] == [(f"s{k}", 1, 2, 0.5, 1.0) for k in range(30)]
