"""Names by grammars of parts: against Python's engine, and by example."""

import re

from pyspark.sql import functions as F

from slicetopo.functions import grammar as G


def told(spark, *names):
    rows = G.components(spark.createDataFrame([(n,) for n in names], "name string")).withColumn("o", G.order()).collect()
    return {r.name: r.asDict(True) for r in rows}


def filled(part):
    return {k: v for k, v in (part or {}).items() if v is not None}


def test_names_by_example(spark):
    got = told(spark, "eval PTVn 60+5mm L a", "PTV-Rectum", "opt PRV 5mm Spinal Cord", "Heart - PTV + 2", "Kidney RT 2", "x Ring 3", "BBs left", "Dose 95[%] max", "Couch Surface", "qqq", None)
    assert filled(got["eval PTVn 60+5mm L a"]["target"]) == {"Mod": "eval", "TargetType": "PTV", "TargetSuffix": "n", "TargetDose": "60", "ExpansionSign": "+", "ExpansionSize2": "5", "ExpansionUnit2": "mm", "TargetLaterality": "L", "SubGroup": "a"}
    one = got["eval PTVn 60+5mm L a"]
    assert (one["cgy"], one["level"], one["expansion_sign"], one["expansion_mm"], one["side"]) == (6000.0, "n", "+", 5.0, "L")
    assert filled(got["PTV-Rectum"]["target"]) == {"TargetType": "PTV", "SubtractionSign": "-", "OrganSubtraction": "Rectum"} and got["PTV-Rectum"]["expansion_sign"] == "-"
    assert filled(got["opt PRV 5mm Spinal Cord"]["organ"]) == {"Opt": "opt", "PRV_Text": "PRV", "PRV_Size": "5", "PRV_Unit": "mm", "BaseOAR": "Spinal Cord"}
    assert filled(got["Heart - PTV + 2"]["organ"])["TargetCrop"] == "PTV" and filled(got["Kidney RT 2"]["organ"]) is not None
    kinds = {n: (r["kind"], r["other_type"]) for n, r in got.items()}
    assert kinds["x Ring 3"] == ("Avoidance", "Ring") and kinds["BBs left"] == ("Marker", "BBs") and kinds["Dose 95[%] max"] == ("Dose", "Dose") and kinds["Couch Surface"] == ("Couch", "Surface") and kinds["qqq"] == (None, None) and kinds[None] == (None, None)


def test_lists_are_sorted_by_kind_dose_and_side(spark):
    got = told(spark, "zzz", "Ring", "Lung R", "Lung L", "Heart", "PTV 50", "PTV 60", "GTV", "Parotid")
    order = sorted(got, key=lambda n: tuple(got[n]["o"].values()))
    assert order == ["GTV", "PTV 50", "PTV 60", "Parotid", "Heart", "Lung L", "Lung R", "Ring", "zzz"]


def test_patterns_mean_the_same_to_another_engine(spark):
    names = [f"{a}{b}{c}{d}" for a in ("", "opt ", "eval_") for b in ("PTV", "gtvn", "Nodes", "Lung", "Hippo", "IGTV2") for c in ("", " 45", "_MIP 50.4Gy", " low") for d in ("", "-Cord", "+3mm", " L", " RT b", "- PTV 3")]
    for table in (G.TARGET, G.ORGAN, G.other("Marker"), G.other("Dose")):
        own = re.compile(G.pattern(table))
        df = spark.createDataFrame([(n,) for n in names], "n string")
        got = {r.n: r.h for r in df.select("n", G.held(F.col("n"), table).alias("h")).collect()}
        assert got == {n: ([g or "" for g in m.groups()] if (m := own.match(n)) else None) for n in names}
        assert len(G.names(table)) == own.groups


def test_places_over_ranges_are_dense_ranks(spark):
    from pyspark.sql import Window

    from slicetopo.operators import places

    rows = [(None if i % 17 == 0 else i % 3, (i * 7919) % 211) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, k int")
    want = df.withColumn("p", F.dense_rank().over(Window.partitionBy("g").orderBy("k"))).distinct()
    assert sorted(map(tuple, places.dense_places(df, "g", "k").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
