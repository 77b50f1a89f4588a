"""What the operators share: written tables that cut lineage, distributed prefix
sums, connected components, and word and hash helpers."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import run_folder, ship

#: ASCII white space, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: Rows an Arrow batch holds at most; whole texts are long, so batches are small.
BATCH_ROWS = 2048
BATCH_BYTES = 16 << 20
#: Rows a bucket of a distributed prefix sum aims at.
BUCKET_ROWS = 8192
#: Keys with more rows than this are dealt over several tasks of a join; of such keys there
#: are at most HOT_KEYS, as the limit rises with the rows.
HOT_ROWS, HOT_KEYS = 512, 10_000
#: Edges up to which no node can be too hot for one task.
FEW_EDGES = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Small Arrow batches, so that a Python worker holds a few MB of text at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The run's part of the folder that spark.checkpoint.dir names; ``session.forget`` deletes
    it when results are written."""
    return run_folder(spark)


def cut(df: DataFrame, seen: list | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a
    lost executor costs no recomputation before it. ``seen``: (count, digest) aggregates
    that are observed while writing, at no further pass."""
    spark = df.sparkSession
    note = Observation()
    if seen is not None:
        digest = F.xxhash64("a", "b")
        df = df.observe(note, F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("d"), F.sum(F.pmod(digest, F.lit(2**31))).alias("s"))
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if seen is not None:
        seen[:] = [(got := note.get)["n"], got["d"], got["s"]]
    return out


def drop(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote, once no later step reads it."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver's references to them do; between
    large steps that is asked for, so that they don't pile up on the executors' disks. The
    scheduler keeps hold of its last job until there is another: a small one takes its place."""
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


def bucket_of(unit: Column, rows: Column) -> Column:
    """Bucket number of a position ``unit`` in [0, 1) in a group of ``rows`` rows;
    it never falls as ``unit`` rises."""
    return F.floor(unit * F.ceil(rows / F.lit(float(BUCKET_ROWS)))).cast("long")


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums of columns within ``group`` by (bucket, order), without
    putting a group into one task: sums per bucket come first (with map-side
    combining), their small table is summed up, and rows are ordered only within
    their bucket. ``bucket`` must not fall along ``order``. ``sums`` names the
    results by the columns they sum."""
    keys = [*group, bucket]
    per = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(per, keys)
    kept = [c for c in df.columns]
    return out.select(*kept, *[(F.col(f"_o_{o}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(o) for o, c in sums.items()])


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (one row for each key) so that no key's rows meet in one
    task. ``counts``: (keys, n), the rows of ``many`` for each key. Rows of a key with more
    than the limit are dealt by a hash of the columns ``by`` over n / limit tasks, and its
    row of ``one`` is repeated for each. The hot keys are broadcast: there are at most
    HOT_KEYS of them, as the limit is at least a HOT_KEYS-th of all rows."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / F.lit(limit)).alias("_salts"))
    if hot.isEmpty():
        return many.join(one, keys, how)
    hot = F.broadcast(cut(hot))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    dealt = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(F.lit(23), *by), salts)).drop("_salts")
    held = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return dealt.join(held, [*keys, "_salt"], how).drop("_salt")


def _with_least(pairs: DataFrame, small: bool) -> DataFrame:
    """``pairs`` (k, v) with m, the least of v for each k."""
    low = pairs.groupBy("k").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if small:
        return pairs.join(low.select("k", "m"), "k")
    low = cut(low)
    return salted_join(pairs, low.select("k", "m"), ["k"], low.select("k", "n"), ["v"])


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that
    links reach. Alternating large-star and small-star rounds; each shrinks the
    distances to the root, so the rounds grow with the logarithm of the longest
    path; if they run out, this raises. Minima are combined before the shuffle, and the
    edges of a hub are dealt over several tasks."""
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), last := [])
    done = not last[0]
    for _ in range(rounds):
        if done:
            break
        small = last[0] <= FEW_EDGES
        both = e.union(e.select("b", "a")).toDF("k", "v")
        # The least neighbour of each node, itself included; its larger neighbours move there.
        large = _with_least(both, small).where("v > k").select(F.col("v").alias("k"), F.least("k", "m").alias("v")).distinct()
        if not small:
            large = cut(large)
        # Each node keeps its least neighbour, and its other ones move to that.
        near = _with_least(large, small).select(F.when(F.col("v") == F.col("m"), F.col("k")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        new = cut(near.where("a <> b").distinct(), now := [])
        drop(e)
        if not small:
            drop(large)
        e = new
        done = now == last
        last = now
    if not done:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the runs (start, length), one after the other."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)
