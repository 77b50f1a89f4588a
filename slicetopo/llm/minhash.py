"""Operator 5, near-duplicate texts: one-permutation hashing with optimal
densification, banded buckets, star-shaped candidate edges, links confirmed on
full shingle sets.

A document's set holds the 64-bit hashes of its distinct word shingles. Rows are
first folded by equal sets, so copies cost one row. The top bits of a hash are its
bin, the smallest hash of a bin its value; an empty bin takes the value of a
non-empty bin that a universal hash of (bin, attempt) names, the same for every
document. Bands of bins are bucket keys. Within a bucket every member gets one edge
to the bucket's centre, so edges grow with members, not with pairs. Edges are
confirmed exactly. Buckets whose members are then still in more than one component
are compared in blocks: every pair of a block of other labels and fitting sizes is
decided by the exact number of hashes in common, and the links that join components
come out. Blocks are cut by members and by hashes, so long texts don't fill a task.

A node is a distinct set. Its number is the smallest doc_id that has it, but for doc_ids
that have several sets: those get a node for each set, linked with each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, mix, salted_join, tune

BINS, ROWS = 128, 4
#: Members and hashes in a block; values in more sets than COMMON are counted by products.
BLOCK, BLOCK_HASHES, COMMON = 512, 400_000, 16


class Hashes(dict):
    """64-bit hashes of words; those of a task's words are kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = Hashes()
KEEP_HASHES = 600_000


def forget_words() -> None:
    _hashes.clear()


def word_ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text. A-Z are
    lower-cased; words are runs without ASCII white space."""
    words, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            w = t.encode("utf-8", "surrogatepass").lower().split()
            counts[i] = len(w)
            words += w
    if len(_hashes) > KEEP_HASHES:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)), counts


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``k`` words make one
    shingle, no word makes none."""
    h, counts = word_ids(texts)
    out, at = [], 0
    rolled = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k if len(rolled) else 0):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(rolled)] + np.uint64(j + 1))
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            one = np.uint64(n)
            for x in h[at : at + n]:
                one = mix(np.array([one]) * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(77))[0]
            out.append(np.array([one]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def probes(bins: int) -> np.ndarray:
    """probes[bin, attempt]: where an empty bin looks, by a universal hash."""
    a, b = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(bins * 4, dtype=np.uint64), indexing="ij")
    return (mix(a * np.uint64(0x100000001B3) + b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)) % np.uint64(bins)).astype(np.int64)


def signature(s: np.ndarray, bins: int, probe: np.ndarray) -> np.ndarray:
    """One value for each bin of a sorted, non-empty set."""
    bin_of = (mix(s) % np.uint64(bins)).astype(np.int64)
    sig = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    sig[bin_of[::-1]] = s[::-1]  # the set is sorted: the last write is the smallest
    full = np.zeros(bins, dtype=bool)
    full[bin_of] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        hits = full[probe[empty]]
        first = hits.argmax(axis=1)
        found = hits[np.arange(len(empty)), first]
        source = np.where(found, probe[empty, first], bin_of[0])
        sig[empty] = sig[source]
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(-1, rows)
    h = np.arange(len(parts), dtype=np.uint64)
    for j in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return h


def similar(n_both: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests by which equal sets meet."""
    if not len(s):
        return 0, 0
    return int(_signed(s.sum(keepdims=True))[0]), int(_signed(np.bitwise_xor.reduce(mix(s + np.uint64(11)), keepdims=True))[0])


def _base(k: int, bins: int, rows: int):
    def run(batches):
        probe = probes(bins)
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), k)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            h1, h2 = (np.array(x, dtype=np.int64) for x in zip(*map(digests, sets), strict=True)) if sets else (n, n)
            keys = [_signed(band_keys(signature(s, bins, probe), rows)) if len(s) else np.zeros(0, dtype=np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n_shingles", "h1", "h2", "keys"])

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            found = shingle_sets(b.column("text").to_pylist(), k)
            wanted = zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), strict=True)
            keep = [i for i, (s, w) in enumerate(zip(found, wanted, strict=True)) if digests(s) == w]
            sets = [_signed(found[i]) for i in keep]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, type=pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "s"])

    return run


def _sets_of(named: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, s): the sets of the wanted (id, doc, h1, h2), from texts of that doc that have
    this set; rows that repeat a text give it once."""
    held = named.join(wanted, named.doc_id == wanted.doc).select("id", "h1", "h2", "text")
    return held.mapInArrow(_sets(k), "id long, s array<long>").dropDuplicates(["id"])


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            x, y = b.column("sa"), b.column("sb")
            keep = []
            for i in range(b.num_rows):
                p, q = np.asarray(x[i].values), np.asarray(y[i].values)
                keep.append(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The exact sizes of the intersections of each left with each right set."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    (x, i), (y, j) = sides
    both = np.intersect1d(x, y)  # what only one side has doesn't count
    if not len(both):
        return out
    at, to = np.searchsorted(both, x), np.searchsorted(both, y)
    keep, hold = both[np.minimum(at, len(both) - 1)] == x, both[np.minimum(to, len(both) - 1)] == y
    v, i, w, j = at[keep], i[keep], to[hold], j[hold]
    n_left, n_right = np.bincount(v, minlength=len(both)), np.bincount(w, minlength=len(both))
    often = n_left * n_right > COMMON
    # Rare values: their pairs one by one.
    rare_v, rare_w = np.flatnonzero(~often[v]), np.flatnonzero(~often[w])
    rare_v, rare_w = rare_v[np.argsort(v[rare_v], kind="stable")], rare_w[np.argsort(w[rare_w], kind="stable")]
    first = np.searchsorted(w[rare_w], v[rare_v])
    times = n_right[v[rare_v]]
    pos = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
    np.add.at(out, (np.repeat(i[rare_v], times), j[rare_w[pos]]), 1)
    # Frequent ones: products of 0-1 matrices, some columns at a time.
    column = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 4096):
        mats = []
        for value, owner, size in ((v, i, len(left)), (w, j, len(right))):
            use = often[value] & (column[value] >= lo) & (column[value] < lo + 4096)
            m = np.zeros((size, 4096), dtype=np.float32)
            m[owner[use], column[value[use]] - lo] = 1
            mats.append(m)
        out += (mats[0] @ mats[1].T).astype(np.int64)
    return out


def _blocks(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, label, side = pdf["id"].to_numpy(), pdf["label"].to_numpy(), pdf["side"].to_numpy()
        sets = [np.asarray(x) for x in pdf["s"]]
        n = np.array([len(s) for s in sets])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        root = {x: x for x in label.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        both = in_common([sets[k] for k in left], [sets[k] for k in right])
        linked = 100 * both >= percent * (n[left][:, None] + n[right][None] - both)
        out = []
        for i, j in zip(*np.nonzero(linked & (label[left][:, None] != label[right][None])), strict=True):
            p, q = find(label[left[i]]), find(label[right[j]])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((ids[left[i]], ids[right[j]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def joined_labels(label: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after further links: components of the components that they join."""
    if more.isEmpty():
        return label
    first = lambda c: F.coalesce(F.col(f"{c}r"), F.col(c)).alias(c)
    ends = more.join(label.toDF("a", "ar"), "a", "left").join(label.toDF("b", "br"), "b", "left").select(first("a"), first("b"))
    new = cut(components(ends))
    old = label.join(new.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(new.join(label.select("node"), "node", "left_anti"))


#: Nodes of sets whose doc_id has several: from here on.
EXTRA = 1 << 62


def _nodes(full: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(h1, h2, node, id, n, copies, keys) of every distinct set, and edges (a, b) between
    the nodes of doc_ids that have several sets, None if there are none."""
    reps = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"), F.min_by("keys", "doc_id").alias("keys"))
    spread = [f(c) for c in ("h1", "h2") for f in (F.min, F.max)]
    several = full.groupBy("doc_id").agg(*[x.alias(f"_{k}") for k, x in enumerate(spread)]).where("_0 <> _1 or _2 <> _3").select(F.col("doc_id").alias("_multi"))
    several = cut(several)
    if several.isEmpty():
        return cut(reps.withColumn("node", F.col("id"))), None
    marked = reps.join(several, F.col("id") == F.col("_multi"), "left")
    own = F.lit(EXTRA) + F.pmod(F.xxhash64("h1", "h2"), F.lit(EXTRA - 1))
    reps = cut(marked.withColumn("node", F.when(F.col("_multi").isNull(), F.col("id")).otherwise(own)).drop("_multi"))
    held = full.select("doc_id", "h1", "h2").join(several, F.col("doc_id") == F.col("_multi"), "left_semi").distinct().join(reps.select("h1", "h2", "node"), ["h1", "h2"])
    low = held.groupBy("doc_id").agg(F.min("node").alias("low"), F.count("*").alias("n"))
    same = salted_join(held, low.select("doc_id", "low"), ["doc_id"], low.select("doc_id", "n"), ["node"])
    return reps, cut(same.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Null or empty texts and texts without a word have an empty set and link with
    nothing. Rows with a null doc_id keep n_shingles, have a null component_id and are
    kept. Rows that repeat a doc_id are in one component, and each of their texts links
    with what is near it. A similarity that just meets the bar is a link. An empty table
    gives an empty result; further columns are ignored."""
    spark = docs.sparkSession
    tune(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = cut(named.mapInArrow(_base(k, bins, rows), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"))
    full = base.where("n_shingles > 0 and doc_id is not null")
    # Only the first of equal sets goes on.
    reps, same = _nodes(full)
    member = reps.select(F.col("node").alias("id"), "n", F.posexplode("keys").alias("band", "key"))
    buckets = cut(member.groupBy("band", "key").agg(F.min("id").alias("c"), F.min_by("n", "id").alias("cn"), F.count("*").alias("size"), F.sum("n").alias("hashes")).where("size > 1"))
    met = salted_join(member, buckets, ["band", "key"], buckets.select("band", "key", F.col("size").alias("n")), ["id"])
    joined = cut(met.select("band", "key", "id", "n", "c", "cn", "size", "hashes"))
    star = joined.where((F.col("id") != F.col("c")) & (100 * F.least("n", "cn") >= percent * F.greatest("n", "cn"))).select(F.col("id").alias("a"), F.col("c").alias("b")).distinct()
    star = cut(star)
    wanted = joined.select("id").distinct().join(reps.select(F.col("node").alias("id"), "h1", "h2", F.col("id").alias("doc")), "id").select("id", "doc", "h1", "h2")
    sets = cut(_sets_of(named, wanted, k))
    of_centre = star.groupBy("b").agg(F.count("*").alias("n"))
    held = star.join(sets.toDF("a", "sa"), "a")
    held = salted_join(held, sets.toDF("b", "sb"), ["b"], of_centre, ["a"])
    links = cut(held.mapInArrow(_confirm(percent), "a long, b long"))
    if same is not None:
        links = links.unionByName(same)
    label = cut(components(links))
    marked = joined.join(label, joined.id == label.node, "left").select("band", "key", "id", "c", "n", "size", "hashes", F.coalesce("root", "id").alias("label"))
    # The centre was compared with every member. Buckets whose other members are in one
    # component are done; buckets of the same members are looked at once.
    marked = cut(marked.where("id <> c"))
    open_ = marked.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("hashes"), F.sum(F.hash("id").cast("long")).alias("d1"), F.bit_xor(F.xxhash64("id")).alias("d2")).where("lo <> hi")
    open_ = cut(open_.groupBy("m", "hashes", "d1", "d2").agg(F.min(F.struct("band", "key")).alias("w")).select("w.band", "w.key", "m", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("hashes") / BLOCK_HASHES)).alias("nb")))
    todo = salted_join(marked.select("band", "key", "id", "label"), open_.select("band", "key", "nb"), ["band", "key"], open_.select("band", "key", F.col("m").alias("n")), ["id"])
    todo = todo.select("band", "key", "id", "label", "nb", (F.pmod(F.xxhash64("id"), F.col("nb"))).alias("blk"))
    with_pair = todo.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o")).select("band", "key", "id", "label", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), F.when(F.col("blk") <= F.col("o"), 0).otherwise(1).alias("side"))
    more = cut(with_pair.join(sets, "id").groupBy("band", "key", "bi", "bj").applyInPandas(_blocks(percent), "a long, b long"))
    label = cut(joined_labels(label, more))
    rooted = reps.join(label, reps.node == label.node, "left").select("h1", "h2", "copies", "id", F.coalesce("root", reps.node).alias("root"))
    if same is not None:
        # Components of extra nodes are named by the smallest doc_id in them.
        rooted = cut(rooted)
        named_by = rooted.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        rooted = salted_join(rooted, named_by.select("root", "least"), ["root"], named_by.select("root", "n"), ["h1"]).select("h1", "h2", "copies", F.col("least").alias("root"))
    rooted = cut(rooted.select("h1", "h2", "copies", "root"))
    got = salted_join(full.select("doc_id", "n_shingles", "h1", "h2"), rooted.select("h1", "h2", "root"), ["h1", "h2"], rooted.select("h1", "h2", F.col("copies").alias("n")), ["doc_id"])
    alone = base.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = got.select("doc_id", "n_shingles", F.least("root", "doc_id").cast("long").alias("component_id")).unionByName(alone)
    for used in (joined, star, sets, marked, open_, more):
        drop(used)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
