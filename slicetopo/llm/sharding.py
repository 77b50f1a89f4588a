"""Operator 10, sharding: balanced label propagation.

Documents start in the shard that a keyed hash names. In each round every group of
linked documents (by a link key; the query links equal texts) looks where most of its
members are, and members elsewhere move there (a group larger than a shard: to as many shards as it
needs) as long as there is room; the
quota of a round is what is free, and movers are ranked by a keyed hash with
distributed prefix sums, so no shard's movers meet in one task. A last step makes the
counts at most one apart: unlinked documents of shards that are too full fill those that
are not. A group larger than a shard fills shards one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import bucket_of, cut, drop, prefix_sums, salted_join

SHARDS, ROUNDS, SEED = 24, 12, 5


def _unit(h: Column) -> Column:
    return (F.pmod(h, F.lit(2**52)) + 0.5) / float(2**52)


def _place(link: Column, h: Column, share: Column, seed: int) -> Column:
    """A position in [0, 1) by which groups stay together and large ones are spread: a
    group starts where its hash says and takes as much room as its share of all rows, so
    its rows come into as many buckets as they need."""
    return (_unit(F.xxhash64(link, F.lit(seed))) + _unit(F.xxhash64(h, F.lit(seed))) * share) / 2


def balance(docs: DataFrame, link: Column, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, link) for every row.

    Size: bytes of the text and 8; null texts have size 8 and crc32 0, that of an empty
    text. A null ``link`` links with nothing. Repeated rows are rows of their own that
    link as equal texts do. Fewer rows than shards leave shards empty; an empty table gives
    an empty result; further columns are ignored. Ties are broken by keyed hashes of
    doc_id and text; equal rows change places freely."""
    base = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))).alias("text_crc32"), link.alias("link"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    base = cut(base)
    n = base.count()
    members = cut(base.where("link is not null").groupBy("link").agg(F.count("*").alias("m")).where("m > 1"))
    counts = members.select("link", F.col("m").alias("n"))
    # Quotas: counts at most one apart.
    low, more = divmod(n, shards)
    quota = lambda s: F.lit(low) + F.when(s < more, 1).otherwise(0)
    start = F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(shards)).cast("int").alias("shard")
    linked = cut(salted_join(base, members, ["link"], counts, ["h", "doc_id"]).select("doc_id", "size", "text_crc32", "link", "h", (F.col("m") / F.lit(float(max(n, 1)))).alias("share"), start))
    free = salted_join(base, members, ["link"], counts, ["h", "doc_id"], "left").where("m is null")
    alone = free.select("doc_id", "size", "text_crc32", "link", "h", F.lit(0.0).alias("share"), start)
    # Linked documents take at most a shard's quota, so that no shard needs to give them up.
    for r in range(rounds):
        here = linked.groupBy("link", "shard").agg(F.count("*").alias("c"))
        # At most ``shards`` entries a group: where it has most, as many as it needs.
        best = F.sort_array(F.collect_list(F.struct("c", F.xxhash64("link", "shard", F.lit(r)).alias("t"), "shard")), asc=False)
        need = F.ceil(F.sum("c") / F.lit(float(max(low, 1)))).cast("int")
        wish = here.groupBy("link").agg(F.transform(F.slice(best, F.lit(1), F.least(need, F.lit(shards))), lambda x: x["shard"]).alias("wants"))
        load = linked.groupBy("shard").agg(F.count("*").alias("load"))
        every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("want")).join(load, F.col("want") == F.col("shard"), "left").select("want", F.greatest(quota(F.col("want")) - F.coalesce("load", F.lit(0)), F.lit(0)).alias("room"))
        wishing = salted_join(linked, cut(wish), ["link"], counts, ["h", "doc_id"])
        goal = F.get(F.col("wants"), F.pmod(F.xxhash64("h", F.lit(seed + r)), F.size("wants")).cast("int"))
        movers = wishing.where(~F.array_contains("wants", F.col("shard"))).withColumn("want", goal).drop("wants")
        total = movers.groupBy("want").agg(F.count("*").alias("movers"))
        # Groups move together: the rank follows the group first.
        ranked = movers.join(F.broadcast(every), "want").join(F.broadcast(total), "want").withColumn("one", F.lit(1)).withColumn("u", _place(F.col("link"), F.col("h"), F.col("share"), seed + r)).withColumn("bucket", bucket_of(F.col("u"), F.col("movers") * 2))
        ranked = prefix_sums(ranked, ["want"], "bucket", ["u", "link", "h"], {"rank": "one"})
        stay = wishing.where(F.array_contains("wants", F.col("shard"))).select(*linked.columns)
        goes = F.col("rank") < F.col("room")
        moved = ranked.withColumn("_moved", goes).withColumn("shard", F.when(goes, F.col("want")).otherwise(F.col("shard"))).select(*linked.columns, "_moved")
        note = Observation()
        moved = moved.observe(note, F.count_if("_moved").alias("n")).drop("_moved")
        new = cut(stay.unionByName(moved))
        drop(linked)
        linked = new
        if not note.get["n"]:
            break
    all_ = cut(linked.withColumn("free", F.lit(0)).unionByName(alone.withColumn("free", F.lit(1))))
    # Within a shard linked documents come first, by group; the tail beyond the quota goes on.
    u = F.when(F.col("free") == 1, 0.5 + _unit(F.xxhash64("h", F.lit(seed))) / 2).otherwise(_place(F.col("link"), F.col("h"), F.col("share"), seed) / 2)
    loads = all_.groupBy("shard").agg(F.count("*").alias("load"))
    placed = all_.withColumn("one", F.lit(1)).withColumn("u", u).join(F.broadcast(loads), "shard").withColumn("bucket", bucket_of(F.col("u"), F.col("load") * 2))
    placed = cut(prefix_sums(placed, ["shard"], "bucket", ["u", "link", "h"], {"rank": "one"}))
    keep = placed.where(F.col("rank") < quota(F.col("shard")))
    over = placed.where(F.col("rank") >= quota(F.col("shard")))
    # Free places, shard by shard, as intervals; at most ``shards`` rows.
    held = {r["shard"]: r["load"] for r in loads.collect()}
    gaps, at = [], 0
    for s in range(shards):
        free = max(0, low + (1 if s < more else 0) - held.get(s, 0))
        if free:
            gaps.append((s, at, at + free))
            at += free
    if gaps:
        spill = [(s, sum(max(0, held.get(x, 0) - low - (1 if x < more else 0)) for x in range(s))) for s in range(shards)]
        before = docs.sparkSession.createDataFrame(spill, "shard int, before long")
        room = docs.sparkSession.createDataFrame(gaps, "goal int, lo long, hi long")
        place = F.col("before") + F.col("rank") - quota(F.col("shard"))
        sent = over.join(F.broadcast(before), "shard").withColumn("place", place).join(F.broadcast(room), (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
        # A filled shard's places follow what it had.
        lo = F.col("place") - F.col("lo")
        had = docs.sparkSession.createDataFrame([(s, held.get(s, 0)) for s in range(shards)], "goal int, had long")
        sent = sent.join(F.broadcast(had), "goal").select("doc_id", "size", "text_crc32", "link", F.col("goal").alias("shard"), (F.col("had") + lo).alias("slot"))
        keep = keep.select("doc_id", "size", "text_crc32", "link", "shard", F.col("rank").alias("slot")).unionByName(sent)
    else:
        keep = keep.select("doc_id", "size", "text_crc32", "link", "shard", F.col("rank").alias("slot"))
    return keep.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "link")


def cut_groups(placed: DataFrame) -> DataFrame:
    """(link, n, shards, least) of linked groups that are in more shards than the ``least``
    that their rows need; ``placed`` is what :func:`balance` gave."""
    full = placed.groupBy("shard").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1
    per = placed.where("link is not null").groupBy("link", "shard").agg(F.count("*").alias("c"))
    groups = per.groupBy("link").agg(F.sum("c").alias("n"), F.count("*").alias("shards")).withColumn("least", F.ceil(F.col("n") / F.lit(full)))
    return groups.where(F.col("shards") > F.col("least"))


def equal_text(docs: DataFrame) -> Column:
    """Links documents with equal texts; null texts link with nothing."""
    return F.when(F.col("text").isNotNull(), F.sha2("text", 256))
