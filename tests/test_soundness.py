"""Definitions: cubes against all patterns of few bits, and every check with a failing file."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from slicetopo.operators import logical, metrics, structures
from slicetopo.operators import kernel as K
from slicetopo.plans import definitions as D
from slicetopo.plans import soundness as S
from slicetopo.sources import generators as G


def holds(p):
    return {x for x in range(1 << 6) if x & p[0] == p[1]}


def test_cubes_against_all_patterns():
    rng = random.Random(3)
    cubes = [(m, rng.randrange(64) & m) for m in (rng.randrange(64) for _ in range(60))]
    for p, q in itertools.combinations(cubes, 2):
        both = D.meet(p, q)
        assert (holds(both) if both else set()) == holds(p) & holds(q)
        parts = [holds(x) for x in S.without(p, q)]
        assert set().union(*parts) == holds(p) - holds(q) and sum(map(len, parts)) == len(holds(p) - holds(q))


def test_definitions_are_disjoint_and_leave_the_rest():
    assert D.overlapping(D.DEFINITIONS) == [] and D.validate() == []
    named = sum(1 << (27 - d.mask.bit_count()) for d in D.DEFINITIONS if d.mask)
    left = S.uncovered()
    assert sum(map(S.size, left)) + named == 1 << 27
    rng = random.Random(5)
    for _ in range(2000):
        x = rng.randrange(1 << 27)
        n = sum(d.mask > 0 and x & d.mask == d.value for d in D.DEFINITIONS)
        assert n + sum(x & m == v for m, v in left) == 1


def test_overlapping_definitions_are_refused(spark):
    twice = [*D.DEFINITIONS, D.Definition("ALIKE", "alike", "~", True, False, False, "ALIKE", (), *D.test_of("T******** ********* *********"))]
    assert any("ALIKE" in x for x in D.validate(twice))
    with pytest.raises(ValueError, match="overlap"):
        D.classify(F.lit(1), twice)
    met = S.overlap_table(D.relation_defs(spark, twice)).collect()
    want = {tuple(sorted(x[:2])) for x in D.overlapping(twice)}
    assert {(r["first"], r["second"]) for r in met} == want and want
    one = next(r for r in met if "EQUAL" in (r["first"], r["second"]))
    assert one["n_patterns"] == 1 << (27 - D.BY_NAME["EQUAL"].mask.bit_count())
    got = spark.range(1).select(S.matches(F.lit(D.BY_NAME["CONTAINS"].value), twice).alias("m")).first().m
    assert got == ["CONTAINS", "ALIKE"]


def sound():
    rows = []
    for d in D.DEFINITIONS:
        pattern = "".join("T" if d.value >> (26 - i) & 1 else "F" if d.mask >> (26 - i) & 1 else "*" for i in range(27))
        row = {"relation_type": d.name, "label": d.label, "symbol": d.symbol, "symmetric": d.symmetric, "transitive": d.transitive, "complementary_relation": d.complement, "pattern": "\t".join((pattern[:9], pattern[9:18], pattern[18:])), "mask": f"0b{d.mask:027b}", "value": f"0b{d.value:027b}", "description": f"about {d.name}", "examples": ["a.png"]}
        if not d.symmetric:
            row["reversed_arrow"] = d.reversed_arrow
        if d.implied:
            row["implied_relation"] = d.implied[0]
        rows.append(row)
    return rows


BREAKS = {
    "structure": lambda r: r["EQUAL"].pop("label"),
    "field_types": lambda r: r["EQUAL"].update(symmetric="yes"),
    "binary_format": lambda r: r["EQUAL"].update(mask="0b1"),
    "pattern_format": lambda r: r["EQUAL"].update(pattern="T*F"),
    "pattern_of_test": lambda r: r["EQUAL"].update(pattern=r["EQUAL"]["pattern"].replace("F", "T")),
    "value_in_mask": lambda r: r["EQUAL"].update(value="0b" + "1" * 27),
    "no_decimals": lambda r: r["EQUAL"].update(mask_decimal=1),
    "test_parts": lambda r: r["EQUAL"].update(value=""),
    "unique_patterns": lambda r: r["EQUAL"].update(pattern=r["CONTAINS"]["pattern"]),
    "unique_tests": lambda r: r["EQUAL"].update(mask=r["CONTAINS"]["mask"], value=r["CONTAINS"]["value"]),
    "unique_types": lambda r: r["EQUAL"].update(relation_type="CONTAINS"),
    "disjoint_tests": lambda r: r["EQUAL"].update(mask="0b1" + "0" * 26, value="0b1" + "0" * 26),
    "symmetric": lambda r: r["EQUAL"].update(complementary_relation="WITHIN"),
    "complement": lambda r: r["CONTAINS"].update(complementary_relation="NONE"),
    "transpose": lambda r: r["CONTAINS"].update(mask="0b" + "1" * 26 + "0"),
    "symbol": lambda r: r["EQUAL"].update(symbol="=="),
    "unique_symbols": lambda r: r["EQUAL"].update(symbol="∅"),
    "complement_symbol": lambda r: r["WITHIN"].update(pattern="", symbol="x"),
    "label": lambda r: r["EQUAL"].update(label="Contains"),
    "arrow": lambda r: r["EQUAL"].update(reversed_arrow=False),
    "one_arrow": lambda r: r["WITHIN"].update(reversed_arrow=False),
    "description": lambda r: r["EQUAL"].update(description="about WITHIN"),
    "implied": lambda r: r["PARTITIONED"].update(implied_relation="BORDERS"),
    "implied_circle": lambda r: (r["PARTITIONED"].update(implied_relation="PARTITIONS"), r["PARTITIONS"].update(implied_relation="PARTITIONED")),
    "examples": lambda r: r["EQUAL"].update(examples=["a.txt"]),
}


def test_every_check_finds_its_fault(spark):
    assert set(BREAKS) == set(S.CHECKS) and S.problems(json.dumps({"Relationships": sound()})) == []
    for check, spoil in BREAKS.items():
        rows = sound()
        spoil({r["relation_type"]: r for r in rows})
        assert check in {c for c, _, _ in S.problems(json.dumps({"Relationships": rows}))}, check
    out = S.report(spark, json.dumps({"Relationships": rows})).collect()
    assert {r.check for r in out if not r.passed} == {"examples"} and len(out) == len(S.CHECKS) >= 20
    texts = spark.createDataFrame([("P", "Q", "A is in B"), ("Q", "P", "B is in A"), ("R", "T", "A on B"), ("T", "R", "A on B")], "relation_type string, complement string, description string")
    assert {r.relation_type for r in S.swapped_descriptions(texts).collect()} == {"R", "T"}


def test_an_implied_path_needs_one_edge_of_its_own(spark):
    # The longest way has implying edges only; a shorter one has an own edge.
    rows = [(1, 2, "PARTITIONED"), (2, 3, "PARTITIONED"), (3, 9, "PARTITIONED"), (1, 4, "PARTITIONED"), (4, 9, "CONTAINS"), (1, 9, "CONTAINS")]
    got = {(r.roi_a, r.roi_b): (r.is_logical, r.intermediates) for r in logical.flags(spark.createDataFrame([("s", *r) for r in rows], "set_id string, roi_a int, roi_b int, relation string")).collect()}
    assert got[1, 9] == (True, [4])


def test_ratios_by_relation(spark):
    part = lambda s, *boxes: [G.cuboid(spark, s, i + 1, *b[:4], **b[4]) for i, b in enumerate(boxes)]
    made = [*part("column", (4, 4, 8, 1, {}), (2, 2, 2, 1, {"x": 2.0})), *part("half", (6, 6, 6, 1, {}), (6, 3, 6, 1, {"y": 1.5})), *part("same", (2, 2, 2, 1, {}), (2, 2, 2, 1, {})), *part("beside", (2, 2, 2, 1, {"x": -1}), (2, 4, 2, 1, {"x": 1}))]
    df = made[0]
    for m in made[1:]:
        df = df.unionByName(m)
    contours = spark.createDataFrame(df.collect(), G.CONTOURS)
    cut = structures.region_slices(contours).cache()
    rel = structures.relations(cut, structures.volumes(contours)).cache()
    got = {r.set_id: (round(r.dice, 6), round(r.overlap_ratio, 6)) for r in metrics.calculate("volume_overlap", cut, rel).collect()}
    # 9 slices of 16 and 3 of 4, of which 3 of 2 are common; 7 of 36 and of 18.
    assert got == {"column": (round(12 / 156, 6), round(12 / 156, 6)), "half": (round(36 / 54, 6), 0.5), "same": (1.0, 1.0)}
    touch = {r.set_id: r for r in metrics.calculate("surface_overlap", cut, rel).collect()}
    assert round(touch["beside"].ratio, 6) == round(2 * 2 / (8 + 12), 6) and (round(touch["beside"].share_a, 6), touch["beside"].share_b) == (round(2 / 12, 6), 0.25)
    frame = [("+", K.ring_of([(0, 0), (9, 0), (9, 9), (0, 9)])), ("-", K.ring_of([(3, 3), (6, 3), (6, 6), (3, 6)]))]
    assert K.outlines(frame, [("+", K.ring_of([(3, 3), (6, 3), (6, 5), (3, 5)]))]) == (7.0, 36.0, 12.0, 10.0, 0.0)


def test_rays_without_cutting_agree_with_the_kernel():
    import numpy as np

    rng = np.random.default_rng(9)
    for _ in range(30):
        a, b = ([("+", rng.uniform(0, 3, 2) + rng.uniform(1, 4) * np.column_stack([np.cos(t), np.sin(t)]))] for t in (np.sort(rng.uniform(0, 6.28, 8)) for _ in range(2)))
        start = rng.uniform(0, 3, 2)
        want = [K.ray_length(a, b, start, start + np.array(d) * 20) for d in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        assert np.allclose(K.axis_lengths(a, b, start), want, atol=1e-5)
