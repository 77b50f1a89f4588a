"""Operator 7, mixing sources to target weights: Efraimidis-Spirakis sampling.

Sources get weights, and from them word targets that never exceed two times what the
source has. A source is first taken whole as often as its target allows (complete
epochs). The rest is a weighted sample without replacement: each document gets the
exponential key -ln(u) / w, u a keyed hash in (0, 1) and w its quality weight; in the
order of these keys, sizes are summed up, and documents are taken until the rest of
the target is reached. The sums are distributed prefix sums over buckets of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bucket_of, cut, prefix_sums, salted_join

#: Weights of the sources in their order, repeating.
CYCLE = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def n_words(text: Column) -> Column:
    """Words, runs without ASCII white space; null has none."""
    parts = F.split(text, f"[{SPACE}]+")
    edge = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce(F.size(parts) - edge, F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.25 to 1: the share of letters and spaces among a text's characters."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\x20\n.,]+", ""))
    return F.coalesce(1 - 0.75 * odd / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, rank, n, source_size, target) from (source, n, source_size). What a source
    can't take is shared again by weight among the others until none is above its limit;
    in closed form, targets are least(limit, level * weight), and the level is found by
    summing up limits in the order in which they are reached."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1).cast("int"))
    named = named.withColumn("w", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    # One row per source: one small window is enough.
    ratio = Window.orderBy((F.col("limit") / F.col("w")), "rank")
    upto, all_ = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    named = named.withColumn("total", F.sum("source_size").over(all_) * share)
    named = named.withColumn("full", F.coalesce(F.sum("limit").over(upto), F.lit(0.0))).withColumn("open", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    named = named.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # The first source whose limit is above the level it would get ends the filling.
    ends = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct("full", "level"))).over(all_)
    target = F.least(F.col("limit"), F.coalesce(ends["level"] * F.col("w"), F.col("limit")))
    return named.select("source", "rank", "n", "source_size", target.alias("target"))


def _pick(docs: DataFrame, weight: Column, seed: int, cycle, share: float, most: float) -> DataFrame:
    """Distinct (id, source, size, text digest) rows with ``copies``, and their source's
    size and target."""
    digest = F.xxhash64(F.lit(seed), "doc_id", "text")
    base = cut(docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), weight.alias("w"), digest.alias("h")))
    sums = base.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    # One row for each source; which side of a join is broadcast, Spark decides by its size.
    plan = cut(targets(sums, cycle, share, most))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    u = (F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    named = lambda df: df.withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    plan = named(plan).drop("source")
    keyed = salted_join(named(base), plan, ["_src"], plan.select("_src", "n"), ["h"]).select("doc_id", "source", "size", "h", "rank", "n", "source_size", "target", "epochs", "rest", (-F.log(u) / F.col("w")).alias("key"))
    keyed = keyed.withColumn("bucket", bucket_of(1 - F.exp(-F.col("key") * 0.75), F.col("n")))
    placed = prefix_sums(keyed, ["rank"], "bucket", ["key", "h", "doc_id"], {"before": "size"})
    extra = F.when((F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")), 1).otherwise(0)
    return placed.withColumn("copies", F.least(F.col("epochs") + extra, F.lit(int(most))).cast("int"))


def mix_sources(docs: DataFrame, weight: Column | None = None, seed: int = 7, cycle=CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) for every row.

    Null texts have size 0. A null source is a source of its own, the last. Sources
    without a word have target 0, and nothing of them is taken but whole epochs of
    nothing. Repeated rows are rows of their own; equal rows share a key and are taken in
    any order among each other. Null weights count as 1. An empty table gives an empty
    result; further columns are ignored. Reruns agree: keys depend on the seed, the
    doc_id and the text only."""
    w = F.greatest(F.coalesce(weight if weight is not None else quality(F.col("text")), F.lit(1.0)), F.lit(1e-6))
    return _pick(docs, w, seed, cycle, share, most).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def mixed(docs: DataFrame, seed: int = 7, cycle=CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: none, once or repeated, and as many as
    :func:`mix_sources` says. Rows of equal id and text that are not all taken alike are
    told apart by drawn numbers, which are written before they are compared."""
    w = F.greatest(F.coalesce(quality(F.col("text")), F.lit(1.0)), F.lit(1e-6))
    pick = _pick(docs, w, seed, cycle, share, most).select("h", "source", "copies")
    # Rows of equal id and text have one digest; those of a source have one key too.
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_mix_s")
    pick = cut(pick.groupBy(F.col("h").alias("_mix_h"), src).agg(F.sum("copies").alias("_mix_t"), F.count("*").alias("_mix_n")).where("_mix_t > 0"))
    keys = ["_mix_h", "_mix_s"]
    own = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.xxhash64(F.lit(seed), "doc_id", "text").alias("_mix_h"), src)
    per = pick.select(*keys, F.expr("_mix_t div _mix_n").alias("_mix_each"), (F.col("_mix_t") % F.col("_mix_n")).alias("_mix_more"))
    back = lambda df, times: df.withColumn("_mix_i", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
    counts = pick.select(*keys, F.col("_mix_n").alias("n"))
    even = back(salted_join(own, per.where("_mix_more = 0"), keys, counts, ["_mix_h"]), F.col("_mix_each"))
    # Only the digest at which a source's rest ends can be taken in part.
    split = per.where("_mix_more > 0")
    if split.isEmpty():
        return even
    part = cut(own.join(split.join(counts, keys), keys).withColumn("_mix_u", F.rand(seed)))
    part = part.withColumn("_mix_b", bucket_of(F.col("_mix_u"), F.col("n"))).withColumn("_mix_one", F.lit(1))
    ranked = prefix_sums(part, keys, "_mix_b", ["_mix_u"], {"_mix_rank": "_mix_one"})
    return even.unionByName(back(ranked, F.col("_mix_each") + F.when(F.col("_mix_rank") < F.col("_mix_more"), 1).otherwise(0)))
