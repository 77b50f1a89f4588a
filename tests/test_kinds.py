"""Pairs of boxes that differ by a move are asked for once in the whole job."""

from pyspark.sql import functions as F

from slicetopo.operators import boxes


def test_kinds_are_asked_once_and_no_pair_is_lost(spark):
    rows = [(s, r, 1, x + s, x + s + 2, 3 * s, 3 * s + 4) for s in range(20) for r, x in ((0, 0), (1, 1), (2, 5))]
    own = spark.createDataFrame([*rows, (99, 0, 1, 0, 2, None, 4), (99, 1, 1, 1, 3, None, 4)], "set_id long, roi long, z long, x0 long, x1 long, y0 long, y1 long")
    asked = []

    def answer(kinds):
        asked.append(kinds.count())
        return kinds.withColumn("shared", F.greatest(F.least("x1_a", "x1_b") - F.greatest("x0_a", "x0_b"), F.lit(0)))

    got = boxes.by_kind(boxes.moved_pairs(own), answer)
    assert got.columns == ["set_id", "roi_a", "roi_b", "z", "shared"]
    assert asked == [4]
    of = {(r.set_id, r.roi_a, r.roi_b): r.shared for r in got.collect()}
    assert of == {(s, a, b): 1 if (a, b) == (0, 1) else 0 for s in range(20) for a, b in ((0, 1), (0, 2), (1, 2))} | {(99, 0, 1): 1}
