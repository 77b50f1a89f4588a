"""Definitions, bits, scalar functions, names, filters, logic, metrics, sources, reports."""

import itertools
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from slicetopo.functions import bits, naming, scalars
from slicetopo.operators import boxes as B
from slicetopo.operators import filters, labels, logical, metrics, report, slices, structures
from slicetopo.plans import definitions as D
from slicetopo.sources import generators as G
from slicetopo.sources import images, rtstruct


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_definitions_are_sound_and_exclusive(spark):
    assert D.validate() == []
    broken = [*D.DEFINITIONS[:2], D.Definition("BAD", "Contains", "x", True, False, False, "NONE", ("OVERLAPS",), 3, 4)]
    assert len(D.validate(broken)) >= 4
    places = (0, 2, 4, 6, 9, 11, 15, 18, 20, 24)
    rows = [(sum(v << (26 - i) for v, i in zip(c, places, strict=True)),) for c in itertools.product((0, 1), repeat=10)]
    names = {}
    for b, relation in spark.createDataFrame(rows, "bits int").select("bits", D.classify(F.col("bits"))).collect():
        found = [d.name for d in D.DEFINITIONS if d.mask and b & d.mask == d.value]
        assert len(found) < 2 and relation == (found or ["UNKNOWN"])[0]
        names[relation] = names.get(relation, 0) + 1
    assert names["UNKNOWN"] == 500 and sum(names.values()) == 1024


def test_bits(spark):
    a = F.lit(0b111001001111001001111001001)
    got = one(spark, t=bits.transpose(a), s=bits.to_text(a), f=bits.from_text(F.lit("212FF1FF2")), m=bits.to_matrix(a), big=bits.to_text(F.lit(1 << 28)))
    assert got.t == D.transpose_int(0b111001001111001001111001001) and got.s == "111001001" * 3 and got.f == 0b111001001
    assert got.m == "111 111 111\n001 001 001\n001 001 001" and got.big is None
    nine = F.lit(0b111001001)
    got = one(spark, a=bits.adjust_boundary(nine, True, False), b=bits.adjust_boundary(nine, False, True), c=bits.adjust_boundary(nine, True, True), h=bits.adjust_hole(F.lit(0b001001111), True), k=bits.adjust_hole(F.lit(0b001001111), False))
    assert (got.a >> 18, got.b >> 18, got.c >> 18) == (bits.BI, bits.IB, bits.BB)
    assert got.h >> 18 == 0b000001001 and got.k >> 18 == 0b000000011


def test_scalars(spark):
    ring = G.box(F.lit(4.0), F.lit(2.0), 1.0, 1.0)
    got = one(spark, r=scalars.round_value(F.lit(0.125), 0.01), z=scalars.round_value(F.lit(1.2345), 0), u=scalars.round_one_up(F.lit(-0.034)), k=scalars.slice_key(F.lit(1.23456)), area=scalars.ring_area(ring), c=scalars.ring_centroid(ring), b=scalars.ring_bounds(ring), y=scalars.truthy(F.lit(" Yes ")), n=scalars.truthy(F.lit(None)), rgba=scalars.hex_to_rgba(F.lit("#ff8000"), 0.5), hex=scalars.rgb_to_hex(F.lit(255), F.lit(0), F.lit(16)), first=scalars.first_filled(F.lit(" "), F.lit("x")), j=scalars.joined("-", F.lit("a"), F.lit(""), F.lit("b")), label=scalars.slice_label(F.lit(1.5)), syn=scalars.fold_synonyms(F.lit("LUNG"), ["lung"], "Lungs"), flo=scalars.floor_ring(ring, 0.5))
    assert (got.r, got.z, got.u, got.k) == (0.125, 1.2345, -0.04, 12346)
    assert got.area == 8 and (got.c.x, got.c.y) == (1, 1) and tuple(got.b) == (-1, 0, 3, 2) and got.y and not got.n
    assert got.rgba == "rgba(255, 128, 0, 0.500)" and got.hex == "#ff0010" and got.first == "x" and got.j == "a-b" and got.label == "1.5000" and got.syn == "Lungs"
    with pytest.raises(ValueError):
        scalars.round_value(F.lit(1.0), -1)
    with pytest.raises(ValueError):
        scalars.floor_to_grid(F.lit(1.0), 0)


def test_names(spark):
    names = ["Lung L", "opt PTV 60 a", "PTV 60a", "eval Bladder b", "zRing", "Parotid_R"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(naming.side_tag(F.col("n")), naming.variant_group(F.col("n")), naming.dose_group(F.col("n"))).collect()]
    assert got == [("L", None, None), ("", "PTV 60", None), ("", None, "PTV60"), ("", "Bladder", None), ("", None, None), ("", None, None)]
    assert [one(spark, c=scalars.hex_to_rgba(F.lit(c))).c for c in ("#102030", "#abc", "red")] == ["rgba(16, 32, 48, 1.000)", "abc", "red"]
    doses = {"6000": "6000", "60Gy": "6000", "50p4Gy": "5040", "2Gyx30": "6000", "what": "what", "10x5": "50", "50.4": "50.4", "60gy": "60gy", "60 cGy": "60 cGy", "1.8Gyx28": "5040", "50x": "50x", "200x0": "200", "12xa": "12xa", "": "", ".5Gy": "50"}
    assert [one(spark, c=naming.dose_fractions(F.lit(d))).c for d in ("2Gyx30", "6000", "12xa")] == [30, None, None]
    assert {r[0]: r[1] for r in spark.createDataFrame([(d,) for d in doses], "n string").select("n", naming.dose_to_cgy(F.col("n"))).collect()} == doses
    assert one(spark, s=naming.swap_ab(F.lit("A is in B, A and B"))).s == "B is in A, A and B"
    assert one(spark, s=naming.strip_upload_prefix(F.lit("upload_01234567-89ab-cdef-0123-456789abcdef_plan.dcm"))).s == "plan.dcm"
    part = one(spark, **naming.parse_name(F.lit("Femur_Head_L"), "organ"))
    assert (part.organ, part.region, part.side) == ("Femur", "Head", "L")


def test_filters(spark):
    rows = spark.createDataFrame([(1, "PTV 60", "PTV"), (2, "zHelp", "CONTROL"), (3, "Heart", "ORGAN")], "roi int, `Structure ID` string, `DICOM Type` string")
    R = filters.Rule
    rules = [R("all", "include", "DICOM Type", "regex", ".+"), R("z", "exclude", "Structure ID", "prefix", "Z"), R("h", "hide", "Structure ID", "exact", "heart", case_sensitive=True), R("bad", "exclude", "Structure ID", "regex", "("), R("list", "hide", "Structure ID", "structure list", ("PTV 60",)), R("other", "hide", "DICOM Type", "structure list", ("ORGAN",)), R("none", "exclude", "Structure ID", "exact", "")]
    got = {r.roi: (r.SelectedByDefault, r.DisplayedByDefault, [m.id for m in r.MatchedRules], r.FinalMatch.id) for r in filters.report(rows, rules).collect()}
    assert got == {1: (True, False, ["all", "list"], "list"), 2: (False, True, ["all", "z"], "z"), 3: (True, True, ["all"], "all")}
    assert tuple(filters.preview(filters.report(rows, rules)).first()) == (3, 2, 1)
    told = filters.from_json('{"rules": [{}, {"match": "prefix", "pattern": "z", "field": "Structure ID", "description": "helpers", "enabled": "yes"}, {"action": "hide", "match": "exact", "value": "Heart", "field": "Structure ID", "with": {"field": "DICOM Type", "match": "exact", "value": "ORGAN"}}, {"action": "drop", "field": "Structure ID"}, {"id": "off", "enabled": "false", "field": "Structure ID", "match": "regex", "value": "."}, {"field": "nothing", "match": "regex", "value": "."}, 5, {"field": "Structure ID", "match": "exact", "value": "Heart", "with": "x"}]}')
    assert [r.id for r in told["rules"]] == ["rule_1", "rule_2", "rule_3", "off", "rule_6", "rule_8"] and [r.enabled for r in told["rules"]][3] is False
    got = {r.roi: r for r in filters.report(rows, **told).collect()}
    assert (got[1].IsFiltered, got[1].MatchedRules, got[1].FinalMatch, got[1].FilterReason) == (False, [], None, "")
    assert got[2].IsFiltered and got[2].FinalMatch.asDict() == {"id": "rule_2", "action": "exclude", "description": "helpers", "field": "Structure ID", "match_type": "prefix", "value": "z", "reason": "Structure ID prefix z"}
    assert (got[3].IsFiltered, got[3].IsHidden, got[3].FilterReason) == (False, True, "Structure ID exact Heart; with DICOM Type exact ORGAN")
    assert filters.from_json('{"include by default": "false", "display by default": "off"}') == {"rules": [], "default": "exclude", "displayed": False}
    assert [r.roi for r in rows.where(filters.name_kept(F.col("Structure ID"), ["PTV", "Heart", "(("], ["Hea"])).collect()] == [1]


def test_logic(spark):
    at = lambda rows: {(r.roi_a, r.roi_b): (r.is_logical, r.intermediates) for r in logical.flags(spark.createDataFrame([("s", *r) for r in rows], "set_id string, roi_a int, roi_b int, relation string")).collect()}
    got = at([(1, 2, "CONTAINS"), (2, 3, "CONTAINS"), (1, 3, "CONTAINS")])
    assert got[1, 3] == (True, [2]) and got[1, 2] == (False, [])
    chain = list(range(1, 24))
    got = at([(a, b, "CONTAINS") for a in chain for b in chain if a < b])
    assert got[1, 23] == (True, chain[1:-1])
    got = at([(1, 2, "CONTAINS"), (2, 3, "PARTITIONED"), (1, 3, "CONTAINS")])
    assert got[1, 3] == (True, [2])
    assert not any(v[0] for v in at([(1, 2, "PARTITIONED"), (2, 3, "PARTITIONED"), (1, 3, "PARTITIONED")]).values())
    got = at([(1, 2, "EQUAL"), (1, 3, "EQUAL"), (2, 3, "EQUAL"), (1, 4, "CONTAINS"), (2, 4, "CONTAINS"), (3, 4, "CONTAINS")])
    assert got[2, 3] == (True, [1]) and got[2, 4] == (True, [1]) and got[1, 4] == (False, [])


def test_display_modes(spark):
    """Three nested volumes: the outermost and the innermost are logical by the one between;
    a fourth case has two between."""
    edges = spark.createDataFrame([("s", 1, 3, True, [2]), ("s", 1, 2, False, []), ("s", 1, 4, True, [2, 3])], "set_id string, roi_a int, roi_b int, is_logical boolean, intermediates array<int>")
    shown = lambda mode, visible=None: [r.shown for r in labels.display_mode(edges, visible, mode).orderBy("roi_b").collect()]
    assert shown("hide") == [True, False, False] and shown("show") == [True] * 3
    assert shown("limited", [1, 2, 3]) == [True, False, False] and shown("limited", [1, 3]) == [True, True, True]
    assert shown("limited", [1, 2, 4]) == [True, False, True] and shown("limited") == [True, False, False]
    assert [r.faded for r in labels.display_mode(edges, [1, 2, 3], "faded").orderBy("roi_b").collect()] == [False, True, True]
    with pytest.raises(ValueError):
        labels.display_mode(edges, [], "other")


def test_labels_of_several_regions(spark):
    def label(whole, *kinds, **how):
        rel = spark.createDataFrame([("s", 1, 2, whole)], "set_id string, roi_a int, roi_b int, relation string")
        per = spark.createDataFrame([("s", 1, 2, "1A", f"2{chr(65 + i)}", k) for i, k in enumerate(kinds)], "set_id string, roi_a int, roi_b int, region_a string, region_b string, relation string")
        return labels.display_label(rel, per, **how).first().label, labels.describe(rel, per, **how).first()

    assert label("CONTAINS", "CONTAINS")[0] == "Contains"
    assert label("CONTAINS", "CONTAINS", "CONTAINS")[0] == "Contains"
    assert label("CONTAINS", "CONTAINS", "DISJOINT")[0] == "{Contains}"
    assert label("CONTAINS", "CONTAINS", "DISJOINT", show_multi=False)[0] == "Contains"
    assert label("UNKNOWN", "DISJOINT", "OVERLAPS", "BORDERS")[0] == "{Borders & Overlaps with & is Disjoint from}"
    assert label("UNKNOWN", "DISJOINT", "CONTAINS", drop_disjoint=True)[0] == "Contains"
    assert label("UNKNOWN", "DISJOINT", "OVERLAPS", drop_overlaps=True)[0] == "is Disjoint from"
    assert label("DISJOINT", "DISJOINT", "DISJOINT", drop_disjoint=True)[0] == "is Disjoint from"
    assert label("UNKNOWN")[0] == "" and label("EQUAL")[0] == "is Equal to"
    told = label("UNKNOWN", "DISJOINT", "WITHIN", "WITHIN", drop_disjoint=True)[1]
    assert (told.consolidated_type, told.has_multiple_regions, told.consolidated_label) == ("UNKNOWN", True, "is Within")
    assert [(x.region_b, x.type) for x in told.per_region] == [("2B", "WITHIN"), ("2C", "WITHIN")]
    assert [tuple(x) for x in told.summary] == [("is Within", "WITHIN", 2)]
    ranks = {r.n: r.r for r in spark.createDataFrame([(n,) for n in (*D.RANK, "UNKNOWN")], "n string").select("n", D.rank(F.col("n")).alias("r")).collect()}
    assert (ranks["EQUAL"], ranks["WITHIN"], ranks["CONFINES"], ranks["BORDERS"], ranks["OVERLAPS"], ranks["DISJOINT"], ranks["UNKNOWN"]) == (1, 5, 6, 10, 13, 14, 99)
    assert one(spark, r=D.rank(F.lit("EQUAL"), compat=True)).r == 99


def test_name_keys_by_example(spark):
    cases = {"zPTV70": (None, "PTV70"), "opt Parotid L a": ("Parotid L", None), "eval PTV b": ("PTV", None), "opt_PTV 60": (None, "PTV60"), "OPT Bladder B": ("Bladder B", None), "CTV 56 b": (None, "CTV56"), "IGTV5a": (None, "IGTV5"), "Bladder": (None, None), "opt ": (None, None)}
    got = {r.n: (r.v, r.d) for r in spark.createDataFrame([(n,) for n in cases], "n string").select("n", naming.variant_group(F.col("n")).alias("v"), naming.dose_group(F.col("n")).alias("d")).collect()}
    assert got == cases
    turn = lambda x: one(spark, s=naming.swap_ab(F.lit(x))).s
    assert turn("B and A") == "B and A" and turn("A and B") == "A and B" and turn("A touches B, CAB") == "B touches A, CAB"
    assert one(spark, s=naming.strip_upload_prefix(F.lit("0123456789abcdef0123456789abcdef_x.dcm"))).s == "0123456789abcdef0123456789abcdef_x.dcm"
    values = {(0.125, 0.01): 0.125, (0.1249, 0.1): 0.12, (7.3, 0.5): 7.3, (2.5, 1.0): 2.5, (123.456, 10.0): 120.0}
    for (x, t), want in values.items():
        assert abs(one(spark, r=scalars.round_value(F.lit(x), t)).r - want) < 1e-9, (x, t)


def test_files_of_definitions_rules_and_metrics(spark):
    text = json.dumps({"Relationships": [{"relation_type": d.name, "label": d.label, "symbol": d.symbol, "symmetric": d.symmetric, "transitive": d.transitive, "reversed_arrow": d.reversed_arrow, "complementary_relation": d.complement, "implied_relation": (d.implied or (None,))[0], "mask": f"0b{d.mask:027b}", "value": f"0b{d.value:027b}"} for d in D.DEFINITIONS]})
    assert D.from_json(text) == D.DEFINITIONS
    assert D.test_of("T*F*T*F** ********* *********") == (89128960, 71303168)
    with pytest.raises(ValueError):
        D.test_of("T*F")
    told = filters.from_json('{"include by default": true, "display by default": false, "rules": [{"id": "z", "action": "exclude", "field": "Structure ID", "match_type": "prefix", "value": "Z", "with": {"field": "DICOM Type", "match_type": "exact", "value": "x"}}, {"id": "l", "action": "display", "field": "Structure ID", "match_type": "structure list", "value": ["A"]}]}')
    rows = spark.createDataFrame([("Zed", "X"), ("zed", "y"), ("A", "x")], "`Structure ID` string, `DICOM Type` string")
    got = {r["Structure ID"]: (r.SelectedByDefault, r.DisplayedByDefault) for r in filters.report(rows, **told).collect()}
    assert got == {"Zed": (False, False), "zed": (True, False), "A": (True, True)}
    config = metrics.Config.from_json('{"enabled_metrics": {"margins": true, "distance": false, "volume": false, "surface": false}, "precision": {"distance": 1}, "margin_settings": {"calculate_maximum": true, "anatomical_labels": {"default_orientation": "FFP"}}, "non_applicable_handling": {"use_nan": false, "use_zero": true}}')
    assert config.metrics() == ["minimum_margins", "maximum_margin"] and (config.distance_decimals, config.orientation, config.not_applicable) == (1, "FFP", "zero")
    for bad in ('{"non_applicable_handling": {"use_nan": true, "use_zero": true}}', '{"non_applicable_handling": {"use_nan": false}}', '{"margin_settings": {"anatomical_labels": {"default_orientation": "up"}}}'):
        with pytest.raises(ValueError):
            metrics.Config.from_json(bad)


def naive_flags(rows):
    """Logical by transitivity alone, by listing every path of a set."""
    step = {}
    for a, b, t in rows:
        if D.BY_NAME[t].transitive:
            step.setdefault(a, set()).add(b)

    def paths(a, b):
        return [[a]] if a == b else [[a, *p] for x in step.get(a, ()) for p in paths(x, b)]

    out = {}
    for a, b, t in rows:
        found = paths(a, b)
        best = min(found, key=lambda p: (-len(p), p), default=[])
        out[a, b] = (True, best[1:-1]) if len(found) > 1 and len(best) > 2 else (False, [])
    return out


def test_transitive_flags_against_all_paths(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for s in range(25):
        own = [(a, b, rng.choice(["CONTAINS", "CONTAINS", "SURROUNDS", "OVERLAPS", "BORDERS"])) for a in range(1, 8) for b in range(a + 1, 8) if rng.random() < 0.6]
        rows += [(str(s), *r) for r in own]
        want |= {(str(s), *k): v for k, v in naive_flags(own).items()}
    got = {(r.set_id, r.roi_a, r.roi_b): (r.is_logical, r.intermediates) for r in logical.flags(spark.createDataFrame(rows, "set_id string, roi_a int, roi_b int, relation string")).collect()}
    assert got == want


def test_slices(spark):
    df = spark.createDataFrame([(1, 1, z) for z in (1, 2, 4, 7)] + [(1, 2, z) for z in range(1, 8)], "set_id int, roi int, z int")
    seq = {r.z: (r.previous_z, r.next_z, r.gap) for r in slices.sequence(df.where("roi = 1"), "set_id", "roi").collect()}
    assert seq == {1: (None, 2, 1.0), 2: (1, 4, 1.5), 4: (2, 7, 2.5), 7: (4, None, 3.0)}
    assert [r.gap for r in slices.sequence(df.where("roi = 1"), "set_id", "roi", signed=True).orderBy("z").collect()] == [1.0, 1.5, 2.5, -3.0]
    got = {r.z: (r.inf1, r.inf2, r.sup1, r.sup2) for r in slices.missing(df, df).collect()}
    assert got == {3: (2, 1, 4, 7), 5: (4, 2, 7, None), 6: (4, 2, 7, None)}
    assert {r.roi: r.has_gaps for r in slices.has_gaps(df).collect()} == {1: True, 2: False}
    wide = slices.presence(df, [1, 2]).where("z = 2").first()
    assert (wide["1"], wide["2"]) == (2, 1)


def test_metrics(spark):
    near = G.cuboid(spark, "apart", 1, 2, 2, 2, 1, x=-3.0).unionByName(G.cuboid(spark, "apart", 2, 2, 2, 2, 1, x=3.0)).unionByName(G.cuboid(spark, "in", 1, 4, 4, 4, 1)).unionByName(G.cuboid(spark, "in", 2, 2, 2, 2, 1)).unionByName(G.cuboid(spark, "mix", 1, 4, 4, 2, 1)).unionByName(G.cuboid(spark, "mix", 2, 4, 4, 2, 1, x=2.0))
    contours = spark.createDataFrame(near.collect(), G.CONTOURS)
    cut = structures.region_slices(contours).cache()
    rel = structures.relations(cut, structures.volumes(contours)).cache()
    assert {r.set_id: r.relation for r in rel.collect()} == {"apart": "DISJOINT", "in": "CONTAINS", "mix": "OVERLAPS"}
    assert metrics.calculate("minimum_distance", cut, rel).first().minimum_distance == 4.0
    m = metrics.calculate("minimum_margin", cut, rel).where("set_id = 'in'").first()
    assert (m.x_plus, m.x_minus, m.y_plus, m.y_minus, m.minimum) == (1.0, 1.0, 1.0, 1.0, 1.0) and m.maximum == 1.41
    dice = {r.set_id: r.dice for r in metrics.calculate("volume_overlap", cut, rel).collect()}
    # All slices of each count: 5 of 16 and 3 of 4, of which 3 of 4 are common.
    assert abs(dice["mix"] - 0.5) < 1e-6 and abs(dice["in"] - 24 / 92) < 1e-6
    with pytest.raises(KeyError):
        metrics.calculate("nothing", cut, rel)
    with pytest.raises(ValueError):
        metrics.register("minimum_distance", None)


def element(group, number, vr, value):
    if vr == b"SQ":
        body = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x for x in value)
        return struct.pack("<HH2s2xI", group, number, vr, len(body)) + body
    value += b" " * (len(value) % 2)
    return struct.pack("<HH2sH", group, number, vr, len(value)) + value


def test_structure_set_files(spark, tmp_path):
    t = rtstruct.TAGS
    e = lambda name, vr, value: element(*t[name], vr, value)
    ring = b"\\".join(str(v).encode() for p in ((0, 0), (40, 0), (40, 40), (0, 40)) for v in (*p, 25))
    contour = e("contour_type", b"CS", b"CLOSED_PLANAR") + e("contour_data", b"DS", ring)
    point = e("contour_type", b"CS", b"POINT") + e("contour_data", b"DS", b"1\\2\\3")
    data = e("modality", b"CS", b"RTSTRUCT") + e("patient_name", b"PN", b"Doe^J") + e("patient_id", b"LO", b"P1") + e("label", b"SH", b"Plan")
    data += e("roi_set", b"SQ", [e("roi_number", b"IS", b"1") + e("roi_name", b"LO", b"PTV 60")]) + e("contour_set", b"SQ", [e("contours", b"SQ", [contour, point]) + e("referenced_roi", b"IS", b"1")])
    code = e("code", b"SH", b"123") + e("scheme", b"SH", b"99X") + e("meaning", b"LO", b"Target")
    density = e("property", b"CS", b"REL_MASS_DENSITY") + e("property_value", b"DS", b"1.1")
    data += e("observations", b"SQ", [e("referenced_roi", b"IS", b"1") + e("roi_type", b"CS", b"PTV") + e("codes", b"SQ", [code]) + e("properties", b"SQ", [density]), e("referenced_roi", b"IS", b"2") + e("roi_type", b"CS", b"ORGAN")])
    meta = element(0x0002, 0x0010, b"UI", b"1.2.840.10008.1.2.1\0")
    head = struct.pack("<HH2sHI", 2, 0, b"UL", 4, len(meta)) + meta
    (tmp_path / "upload_plan.dcm").write_bytes(b"\0" * 128 + b"DICM" + head + data)
    (tmp_path / "other.dcm").write_bytes(b"nothing")
    got = rtstruct.contours(spark, str(tmp_path)).collect()
    assert [(r.set_id == r.path, r.label, r.roi, r.z, len(r.points), r.points[1].x) for r in got] == [(True, "Plan", 1, 2.5, 4, 4.0)]
    sets = rtstruct.structure_sets(spark, str(tmp_path)).collect()
    assert [(r.last_name, r.label, r.file) for r in sets] == [("Doe", "Plan", "plan.dcm")]
    assert [r.relative_path for r in sets] == ["upload_plan.dcm"]
    meta = rtstruct.filter_metadata(*(f(spark, str(tmp_path)) for f in (rtstruct.rois, rtstruct.observations, rtstruct.contours))).collect()
    assert [(m["roi"], m["Structure ID"], m["DICOM Type"], m["Code"], m["Coding Scheme"], m["Code Meaning"], m["Density"], m["Contour Count"], m["Has Contours"]) for m in meta] == [(1, "PTV 60", "PTV", "123", "99X", "Target", "1.1", 1, True), (2, "", "ORGAN", "", "", "", "", 0, False)]
    lost = {r.path.rsplit("/", 1)[1]: r.problem for r in rtstruct.problems(spark, str(tmp_path)).collect()}
    assert list(lost) == ["other.dcm"] and lost["other.dcm"].startswith("unreadable")


def test_reports(spark, tmp_path):
    rel = spark.createDataFrame([(1, 1, 2, "CONTAINS", True), (1, 1, 3, "DISJOINT", False)], "set_id int, roi_a int, roi_b int, relation string, is_logical boolean")
    cells = {(r.row_roi, r.col_roi): (r.label, r.symbol) for r in report.symbols(B.matrix_long(rel, spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "set_id int, roi int"))).collect()}
    assert cells[2, 1] == ("[Contains]", "[⊂]") and cells[1, 2] == ("[is Within]", "[⊃]") and cells[1, 1] == ("is Equal to", "=")
    assert report.symbols(rel).where("roi_b = 2").first().label == "[Contains]"
    assert report.diagram_edges(rel).count() == 1 and report.diagram_edges(rel, show_disjoint=True).count() == 2
    # Equal structures share an edge to an outside one: that of the first stays direct.
    same = spark.createDataFrame([(1, 1, 2, "EQUAL"), (1, 1, 9, "CONTAINS"), (1, 2, 9, "CONTAINS"), (1, 2, 8, "BORDERS")], "set_id int, roi_a int, roi_b int, relation string")
    edges = lambda mode: {(r.roi_a, r.roi_b): (r.label, r.is_logical, r.faded, r.layout_candidate) for r in report.diagram_edges(same, mode=mode).collect()}
    assert edges("show")[2, 9] == ("[Contains]", True, False, True) and edges("show")[1, 9] == ("Contains", False, False, True) and edges("show")[2, 8] == ("Borders", False, False, True)
    assert (2, 9) not in edges("hide") and edges("faded")[2, 9] == ("[Contains]", True, True, False)
    nodes = {r.roi: r for r in report.diagram_nodes(spark.createDataFrame([(1, "PTV 60 L", "PTV", [255, 0, 16], 1.5, 2), (2, "x", None, None, 0.0, 0)], "roi int, name string, roi_type string, color array<int>, volume double, num_regions int")).collect()}
    assert (nodes[1].shape, nodes[1].color, nodes[1].title) == ("diamond", "#ff0010", "PTV 60 L (ROI 1)\nType: PTV\nVolume: 1.50 cm³\nRegions: 2") and nodes[2].color == "#c8c8c8"
    told = json.loads(report.payload(same.withColumn("is_logical", F.col("roi_b") == 9).withColumn("intermediates", F.array(F.lit(1))), spark.createDataFrame([(1, r, f"n{r}", [1, 2, r]) for r in (1, 2, 8, 9)], "set_id int, roi int, name string, color array<int>"), spark.createDataFrame([(1, 1, 0.5, False), (1, 1, 1.0, True)], "set_id int, roi int, z double, is_interpolated boolean"), report.slice_records(same.withColumn("z", F.lit(0.5))), mode="faded").first().payload)
    assert told["rows"] == [1, 2, 8, 9] and told["row_names"] == ["n1", "n2", "n8", "n9"] and told["data"][3][0] == "[Contains]" and told["colors"]["9"] == [1, 2, 9]
    assert told["faded_relationships"] == {"0_3": True, "1_3": True, "3_0": True, "3_1": True} and told["structure_slices_interpolated"] == {"1": [1.0]}
    assert told["slice_relationships"]["1|9"]["0.5000"] == {"label": "Contains", "symbol": "⊂", "is_interpolated": False, "has_boundary": False} and told["unit"] == "cm"
    hidden = json.loads(report.payload(same.withColumn("is_logical", F.col("roi_b") == 9), spark.createDataFrame([(1, r) for r in (1, 2, 8, 9)], "set_id int, roi int"), mode="hide").first().payload)
    assert hidden["data"][3][0] is None and hidden["data"][1][0] == "is Equal to"
    got = one(spark, a=report.resolve(F.lit("BORDERS"), F.lit(True), F.lit("CONTAINS")), b=report.resolve(F.lit(None), F.lit(True), F.lit("CONTAINS")), c=report.resolve(F.lit(None), F.lit(False), F.lit(None)))
    assert tuple(got) == ("BORDERS", "EQUAL", "UNKNOWN")
    report.export_csv(rel, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    ext = spark.createDataFrame([(1, "Body", 30.0, 20.0), (1, "x", 50.0, 50.0), (2, "y", 10.0, 40.0)], "set_id int, name string, dx double, dy double")
    assert {r.set_id: r.resolution for r in report.resolution(ext).collect()} == {1: 0.03, 2: 0.04}


def test_the_llm_part_can_go():
    import pathlib

    root = pathlib.Path(B.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text().replace("llm/", ""), p


def test_image_files(spark, tmp_path):
    def file(name, modality, patient, frame):
        data = element(0x0008, 0x0060, b"CS", modality) + element(0x0010, 0x0020, b"LO", patient) + element(0x0020, 0x000D, b"UI", b"1.2\0") + element(0x0020, 0x0052, b"UI", frame)
        meta = element(0x0002, 0x0010, b"UI", b"1.2.840.10008.1.2.1\0")
        (tmp_path / name).write_bytes(b"\0" * 128 + b"DICM" + struct.pack("<HH2sHI", 2, 0, b"UL", 4, len(meta)) + meta + data)

    for row in (("a.dcm", b"CT", b"P1", b"9.9\0"), ("b.dcm", b"MR", b"P1", b"8.8\0"), ("c.dcm", b"CT", b"P2", b"8.8\0"), ("d.dcm", b"RTSTRUCT", b"P1", b"8.8\0")):
        file(*row)
    got = images.image_files(spark, str(tmp_path), "P1", frame="8.8").collect()
    assert [(r.path.rsplit("/", 1)[1], r.matches_frame) for r in got] == [("b.dcm", True), ("a.dcm", False)]
    assert images.image_files(spark, str(tmp_path), "P1", study_uid="7").count() == 0


def test_region_relations(spark):
    parts = G.cuboid(spark, "s", 1, 2, 2, 4, 1, x=-4.0).unionByName(G.cuboid(spark, "s", 1, 2, 2, 4, 1, x=4.0)).unionByName(G.cuboid(spark, "s", 2, 1, 1, 2, 1, x=-4.0))
    contours = spark.createDataFrame(parts.collect(), G.CONTOURS)
    got = {(r.region_a, r.region_b): r.relation for r in structures.region_relations(structures.regions(contours), structures.volumes(contours)).collect()}
    assert sorted(got.values()) == ["CONTAINS", "DISJOINT"] and {a for a, _ in got} == {"1A", "1B"} and {b for _, b in got} == {"2A"}
