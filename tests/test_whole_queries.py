"""Registered queries over every row and every kind, against plain Python."""

import re
from collections import Counter

from slicetopo import catalog
from slicetopo.functions import naming

DATA = "/root/testdata/sf0.001"


def test_every_name_meets_every_grammar(spark, monkeypatch):
    own = ["PTVp1_6000a", "gtv 40", "opt CTV 60b", "PTV 60+5mm", "Skin-3", "Femur_Head_L", "eval Bladder", "Cord_PRV05", "CTV600", "++", ""]
    extra = spark.createDataFrame([(-i - 1, n) for i, n in enumerate(own)], "roi long, name string")
    names = catalog._names
    monkeypatch.setattr(catalog, "_names", lambda s, d: names(s, d).unionByName(extra))
    want = {r.roi: r.name for r in catalog._names(spark, DATA).collect()}
    got = {r.roi: r for r in catalog.QUERIES["name_grammar_all"](spark, DATA).collect()}
    assert got.keys() == want.keys() and {r % 3 for r in got} == {0, 1, 2}
    for roi, name in want.items():
        took = []
        for g in ("target", "margin", "organ"):
            m = re.search(naming.GRAMMARS[g], name.strip(), re.IGNORECASE)
            took += [g] if m else []
            for k in re.compile(naming.GRAMMARS[g]).groupindex:
                assert got[roi][f"{g}_{k}"] == (m and m[k] or None), (name, g, k)
        assert got[roi].grammar == (took or [None])[0]
    assert {r.grammar for r in got.values()} == {"target", "margin", "organ", None}


def test_slices_count_every_relation(spark):
    want = {}
    for r in catalog.QUERIES["box_slice_relations"](spark, DATA).collect():
        want.setdefault(r.z, Counter())[r.relation] += 1
    got = {r.z: r.asDict() for r in catalog.QUERIES["relation_slice_pivot_all"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    for z, r in got.items():
        assert {k: r[k] for k in r if k not in ("z", "pairs") and r[k]} == want[z]
        assert r["pairs"] == sum(want[z].values())
    assert sum(r["PARTITIONED"] + r["PARTITIONS"] for r in got.values()) > 0
