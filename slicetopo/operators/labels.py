"""How relations are shown: by rank, with their regions, and when they follow from others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import definitions as D

PAIR = ("set_id", "roi_a", "roi_b")


def _dropped(relation: Column, drop_disjoint: bool, drop_overlaps: bool) -> Column:
    names = [n for n, drop in (("DISJOINT", drop_disjoint), ("OVERLAPS", drop_overlaps)) if drop]
    return relation.isin(*names) if names else F.lit(False)


def count_by_rank(per_region: DataFrame, drop_disjoint: bool = False, drop_overlaps: bool = False, compat: bool = False) -> DataFrame:
    """(set_id, roi_a, roi_b, n_pairs, ranked): of each pair of structures the number of its
    pairs of regions, and an array of (rank, count, relation, label) without what is dropped,
    by rank and then by falling count."""
    kept = ~_dropped(F.col("relation"), drop_disjoint, drop_overlaps)
    per = per_region.groupBy(*PAIR, "relation").agg(F.count("*").alias("n"))
    entry = F.struct(D.rank(F.col("relation"), compat).alias("rank"), (-F.col("n")).alias("_down"), "relation", F.col("n").alias("count"), D.lookup(F.col("relation"), "label").alias("label"))
    found = per.groupBy(*PAIR).agg(F.sum("n").alias("n_pairs"), F.array_sort(F.collect_list(F.when(kept, entry))).alias("ranked"))
    return found.withColumn("ranked", F.transform("ranked", lambda x: F.struct(x["rank"].alias("rank"), x["count"].alias("count"), x["relation"].alias("relation"), x["label"].alias("label"))))


def _label(relation: Column, n_pairs: Column, ranked: Column, show_multi: bool) -> Column:
    base = F.when(relation == "UNKNOWN", "").otherwise(F.coalesce(D.lookup(relation, "label"), F.lit("")))
    if not show_multi:
        return base
    together = F.concat(F.lit("{"), F.array_join(F.transform(ranked, lambda x: x["label"]), " & "), F.lit("}"))
    several = F.when(F.size(ranked) == 1, F.element_at(ranked, 1)["label"]).when(relation != "UNKNOWN", F.concat(F.lit("{"), base, F.lit("}"))).otherwise(together)
    return F.when((F.coalesce(n_pairs, F.lit(0)) <= 1) | (F.size(F.coalesce(ranked, F.array())) == 0), base).otherwise(several)


def display_label(relations: DataFrame, per_region: DataFrame, show_multi: bool = True, drop_disjoint: bool = False, drop_overlaps: bool = False) -> DataFrame:
    """(set_id, roi_a, roi_b, label) of each of ``relations``, by the relations of its pairs of
    regions. One pair of regions, or one kind of relation among them: its label without
    braces. Several kinds: the pair's own label in braces, or, if that is unknown, all labels
    by rank, joined by an ampersand, in braces. Unknown alone has an empty label."""
    counts = count_by_rank(per_region, drop_disjoint, drop_overlaps)
    return relations.join(counts, list(PAIR), "left").select(*PAIR, _label(F.col("relation"), F.col("n_pairs"), F.col("ranked"), show_multi).alias("label"))


def describe(relations: DataFrame, per_region: DataFrame, show_multi: bool = True, drop_disjoint: bool = False, drop_overlaps: bool = False) -> DataFrame:
    """(set_id, roi_a, roi_b, consolidated_label, consolidated_type, has_multiple_regions,
    per_region, summary): per_region has (region_a, region_b, label, type) of each pair of
    regions, summary (label, type, count) of each kind by rank."""
    counts = count_by_rank(per_region, drop_disjoint, drop_overlaps)
    entry = F.struct("region_a", "region_b", D.lookup(F.col("relation"), "label").alias("label"), F.col("relation").alias("type"))
    kept = ~_dropped(F.col("relation"), drop_disjoint, drop_overlaps)
    each = per_region.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.when(kept, entry))).alias("per_region"))
    got = relations.join(counts, list(PAIR), "left").join(each, list(PAIR), "left")
    summary = F.transform("ranked", lambda x: F.struct(x["label"].alias("label"), x["relation"].alias("type"), x["count"].alias("count")))
    none = F.array()
    return got.select(
        *PAIR,
        _label(F.col("relation"), F.col("n_pairs"), F.col("ranked"), show_multi).alias("consolidated_label"),
        F.col("relation").alias("consolidated_type"),
        (F.coalesce("n_pairs", F.lit(0)) > 1).alias("has_multiple_regions"),
        F.coalesce("per_region", none.cast("array<struct<region_a:string,region_b:string,label:string,type:string>>")).alias("per_region"),
        F.coalesce(summary, none.cast("array<struct<label:string,type:string,count:bigint>>")).alias("summary"),
    )


MODES = ("hide", "limited", "faded", "show")


def display_mode(logical_edges: DataFrame, visible: list[int] | None, mode: str) -> DataFrame:
    """Edges with ``shown`` and ``faded``, from is_logical and intermediates. hide drops
    logical edges; limited drops those all of whose intermediates are visible; faded and show
    keep all, and faded marks logical ones. No list of visible structures means all are."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    is_logical = F.coalesce("is_logical", F.lit(False))
    hidden = F.lit(0) if not visible else F.size(F.array_except("intermediates", F.array(*map(F.lit, visible)).cast(dict(logical_edges.dtypes)["intermediates"])))
    shown = {"hide": ~is_logical, "limited": ~(is_logical & (hidden == 0)), "faded": F.lit(True), "show": F.lit(True)}[mode]
    return logical_edges.withColumn("shown", shown).withColumn("faded", is_logical if mode == "faded" else F.lit(False))
