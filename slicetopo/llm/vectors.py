"""Operator 4, near-duplicate embeddings: spherical k-means cells, blocked cosine
products within cells, one representative of each group.

Equal vectors are folded first. Centroids are fitted on a bounded sample; every vector
belongs to the cell of its nearest centroid, and is a guest of each earlier cell that
can hold a vector similar enough: with unit vectors and the bar t, a vector within the
angle acos(t) of x lies in cell c only if (x.own - x.c) <= sqrt(1 - t^2) |own - c|. So
each pair above the bar meets in exactly one cell, and no link is lost. A cell's vectors
are packed into blocks, one row each, which know the cells that any of their vectors may be a
guest of. Blocks meet blocks in a Cartesian product that skips those that can't link: both sides
are read from the written blocks, so nothing is copied to disk for a meeting, and what is
written grows with the vectors however many blocks meet. A hot cell is spread over many tasks.
Products are made in single precision with a safe margin, and what comes near the bar
is decided in double precision. A task returns link counts and the links of a spanning
forest of what it saw, so a group of m vectors gives about m rows, not m squared.

A node is a distinct vector. Its number is the smallest vec_id that has it, but for
vec_ids that have several vectors: those get a node for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, salted_join, tune

BAR = 0.9
#: Vectors in the sample for the centroids; vectors a cell aims at; vectors in a block.
SAMPLE, CELL, BLOCK = 20_000, 4096, 2048
#: Most centroids of one vector length; a sample of any length has this many vectors at least.
CENTROIDS, LEAST = 4096, 64
#: Pairs of blocks in an Arrow batch.
ROWS = 4
#: Cells up to which tables about cells are broadcast.
SMALL = 100_000
#: Nodes of vectors whose vec_id has several: from here on.
EXTRA = 1 << 62


def fit(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Centroids of spherical k-means; the first are spread over the sample."""
    rng = np.random.default_rng(11)
    c = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))].copy()
    for _ in range(steps):
        own = (x @ c.T).argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        size = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(size > 0, new / np.maximum(size, 1e-30), c)
    return c


def unit(x: np.ndarray) -> np.ndarray | None:
    """``x`` scaled to length 1, by its largest part first, so that no square overflows or
    vanishes; None for a zero vector and one with a part that is not finite."""
    top = np.abs(x).max(initial=0.0)
    if not np.isfinite(x).all() or not top:
        return None
    x = x / top
    return x / np.linalg.norm(x)


def _clean(batches):
    """Unit vectors (double) of usable rows, and a digest by which equal vectors meet; null
    for the others."""
    import hashlib

    for b in batches:
        units, keys = [], []
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
            raw = v.values if v.is_valid else None
            x = None
            if i is not None and raw is not None and len(raw) and not raw.null_count:
                x = unit(raw.to_numpy(zero_copy_only=False).astype(np.float64))
            units.append(None if x is None else x.tolist())
            # Zeros of either sign are one.
            keys.append(None if x is None else hashlib.blake2b((raw.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).tobytes(), digest_size=16).hexdigest())
        dims = [None if x is None else len(x) for x in units]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, type=pa.string()), pa.array(dims, type=pa.int32()), pa.array(units, type=pa.list_(pa.float64()))], names=["vec_id", "key", "dim", "x"])


def _cells(shared):
    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = part.column("x").flatten().to_numpy().reshape(-1, d)
                own = (x @ shared.value[d].T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], names=["vec_id", "n", "dim", "x", "cell"])

    return run


#: A block of a cell's vectors; ``home`` and ``meets`` are numbers of cells among all lengths.
BLOCKS = "home long, blk long, dim int, ids binary, n binary, x binary, meets array<long>"
#: Link counts that a task holds before it sums them up.
HELD = 1_000_000


def _place(dim: int, cell):
    return (dim << 32) + cell


def _pack(shared, bar: float):
    reach = float(np.sqrt(max(0.0, 1 - bar * bar))) + 1e-9

    def run(key, t):
        d, cell, blk = (k.as_py() for k in key)
        c = shared.value[d]
        x = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
        s = x @ c[: cell + 1].T
        far = np.sqrt(np.maximum(0, 2 - 2 * c[: cell + 1] @ c[cell]))
        meets = ((s[:, cell][:, None] - s) <= reach * far[None] + 1e-9).any(axis=0)
        meets[cell] = True
        whole = lambda name: t.column(name).to_numpy().astype("<i8").tobytes()
        row = {"home": _place(d, cell), "blk": blk, "dim": d, "ids": whole("vec_id"), "n": whole("n"), "x": x.astype("<f8").tobytes(), "meets": _place(d, np.flatnonzero(meets)).tolist()}
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array([v], type=k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

    return run


def _links(x: np.ndarray, y: np.ndarray, same: bool, bar: float):
    """Runs of places (i, j) of vectors of two blocks whose cosine reaches the bar; each pair of
    a block with itself once."""
    for lo in range(0, len(x), 512):
        i, j = np.nonzero(x[lo : lo + 512].astype(np.float32) @ y.astype(np.float32).T >= np.float32(bar - 1e-4))
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 200_000):
            p, q = i[at : at + 200_000], j[at : at + 200_000]
            ok = np.einsum("ij,ij->i", x[p], y[q]) >= bar
            yield p[ok], q[ok]


def _compare(bar: float):
    def meet(row: dict) -> tuple[np.ndarray, np.ndarray, list]:
        """Vectors of two blocks, their numbers of links, and the links of a spanning forest."""
        whole = lambda side, name: np.frombuffer(row[f"{side}_{name}"], dtype="<i8")
        x, y = (np.frombuffer(row[f"{side}_x"], dtype="<f8").reshape(-1, row["dim"]) for side in "ab")
        ids, n = (np.concatenate([whole("a", name), whole("b", name)]) for name in ("ids", "n"))
        links, root, out = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), []

        def find(a):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        shift = 0 if row["same"] else len(x)
        for p, q in _links(x, y, row["same"], bar):
            q = q + shift
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            for a, b in zip(p.tolist(), q.tolist(), strict=True):
                u, v = find(a), find(b)
                if u != v:
                    root[v] = u
                    out.append((ids[a], ids[b]))
        got = np.flatnonzero(links)
        return ids[got], links[got], out

    def batch(ids, links, other) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(links, type=pa.int64()), pa.array(other, type=pa.int64())], names=["vec_id", "n_links", "other"])

    def run(batches):
        held, size = [], 0

        def summed():
            ids, at = np.unique(np.concatenate([i for i, _ in held]), return_inverse=True)
            total = np.zeros(len(ids), dtype=np.int64)
            np.add.at(total, at.ravel(), np.concatenate([k for _, k in held]))
            return ids, total

        for b in batches:
            for row in b.to_pylist():
                ids, links, out = meet(row)
                if out:
                    a, o = zip(*out, strict=True)
                    yield batch(a, np.zeros(len(a), dtype=np.int64), o)
                    held.append((ids, links))
                    size += len(ids)
                if size > HELD:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield batch(*held.pop(), [None] * size)
                        size = 0
        if held:
            ids, total = summed()
            yield batch(ids, total, [None] * len(ids))

    return run


def centroids(reps: DataFrame, sample: int, cell: int) -> dict[int, np.ndarray]:
    """Centroids for each vector length, from a sample that all lengths share by their
    numbers of vectors; one job draws it, by a hash of the vectors."""
    counts = {r["dim"]: r["c"] for r in reps.groupBy("dim").agg(F.count("*").alias("c")).collect()}
    total, scale = sum(counts.values()), 1 << 40
    want = {d: min(c, max(LEAST, sample * c // total)) for d, c in counts.items()}
    limit = F.lit(0).cast("long")
    for d, c in counts.items():
        limit = F.when(F.col("dim") == d, F.lit(min(scale, want[d] * scale // c))).otherwise(limit)
    drawn = reps.where(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(scale)) < limit).select("dim", "key", "x").toArrow().sort_by("key")
    out = {}
    dims = drawn.column("dim").to_numpy()
    for d, c in counts.items():
        own = drawn.filter(pa.array(dims == d)).column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
        if not len(own):
            own = np.eye(1, d)
        out[d] = fit(own, max(1, min(CENTROIDS, round(c / cell))))
    return out


def _nodes(clean: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, dim, vec_id, n, x, node) of every distinct vector, and edges (a, b) between the
    nodes of vec_ids that have several vectors, None if there are none."""
    reps = clean.groupBy("key", "dim").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.min_by("x", "vec_id").alias("x"))
    several = cut(clean.groupBy("vec_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select(F.col("vec_id").alias("_multi")))
    if several.isEmpty():
        return cut(reps.withColumn("node", F.col("vec_id"))), None
    own = F.lit(EXTRA) + F.pmod(F.xxhash64("key"), F.lit(EXTRA - 1))
    reps = cut(reps.join(several, F.col("vec_id") == F.col("_multi"), "left").withColumn("node", F.when(F.col("_multi").isNull(), F.col("vec_id")).otherwise(own)).drop("_multi"))
    held = clean.select("vec_id", "key", "dim").join(several, F.col("vec_id") == F.col("_multi"), "left_semi").distinct().join(reps.select("key", "dim", "node"), ["key", "dim"])
    low = held.groupBy("vec_id").agg(F.min("node").alias("low"), F.count("*").alias("n"))
    same = salted_join(held, low.select("vec_id", "low"), ["vec_id"], low.select("vec_id", "n"), ["node"])
    return reps, cut(same.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))


def near_vectors(vectors: DataFrame, bar: float = BAR, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Null, empty and zero vectors and vectors with null or non-finite parts link with
    nothing. Vectors of unequal lengths link with nothing of another length. Rows that
    repeat a vec_id are vectors of their own: copies link with each other, each row shows
    its own vector's links, and all are in one component. A cosine that equals the bar is a
    link. A null vec_id links with nothing and is kept. An empty table gives an empty
    result; further columns are ignored."""
    spark = vectors.sparkSession
    tune(spark, 4096)
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = cut(named.mapInArrow(_clean, "vec_id long, key string, dim int, x array<double>"))
    clean = rows.where("key is not null")
    reps, twins = _nodes(clean)
    shared = spark.sparkContext.broadcast(centroids(reps, sample, cell))
    held = cut(reps.select(F.col("node").alias("vec_id"), "n", "dim", "x").mapInArrow(_cells(shared), "vec_id long, n long, dim int, x array<double>, cell int"))
    # Blocks of each cell; at most CENTROIDS rows for each vector length.
    many = cut(held.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).alias("nb")))
    if many.count() <= SMALL:
        placed = held.join(F.broadcast(many.drop("n")), ["dim", "cell"])
    else:
        placed = salted_join(held, many.drop("n"), ["dim", "cell"], many.select("dim", "cell", "n"), ["vec_id"])
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("nb")))
    blocks = cut(placed.groupBy("dim", "cell", "blk").applyInArrow(_pack(shared, bar), BLOCKS))
    # Blocks of the cells that a block may have links in; each two blocks of a cell once. The
    # hint asks for the Cartesian product, which shuffles nothing.
    p, q = blocks.alias("p"), blocks.alias("q").hint("shuffle_replicate_nl")
    same = F.col("p.home") == F.col("q.home")
    met = p.join(q, F.array_contains("p.meets", F.col("q.home")) & (~same | (F.col("p.blk") >= F.col("q.blk"))))
    met = met.select(F.col("p.dim").alias("dim"), (same & (F.col("p.blk") == F.col("q.blk"))).alias("same"), *[F.col(f"{t}.{c}").alias(f"{side}_{c}") for t, side in (("p", "a"), ("q", "b")) for c in ("ids", "n", "x")])
    tune(spark, ROWS)
    found = cut(met.mapInArrow(_compare(bar), "vec_id long, n_links long, other long"))
    tune(spark, 4096)
    edges = found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
    label = cut(components(edges if twins is None else edges.unionByName(twins)))
    links = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    of = reps.select("key", "dim", F.col("vec_id").alias("least"), "node", "n").join(links, F.col("node") == links.vec_id, "left").select("key", "dim", "least", "node", "n", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    of = of.join(label.toDF("_node", "root"), F.col("node") == F.col("_node"), "left").select("key", "dim", "least", "n", "n_links", F.coalesce("root", "node").alias("root"))
    if twins is not None:
        # Components of extra nodes are named by the smallest vec_id in them.
        of = cut(of)
        named_by = of.groupBy("root").agg(F.min("least").alias("low"), F.count("*").alias("n"))
        of = salted_join(of, named_by.select("root", "low"), ["root"], named_by.select("root", "n"), ["key"]).withColumn("root", F.col("low"))
    of = cut(of.select("key", "dim", "n", "n_links", "root"))
    got = salted_join(clean.select("vec_id", "key", "dim"), of.drop("n"), ["key", "dim"], of.select("key", "dim", "n"), ["vec_id"])
    for used in (held, many, blocks):
        drop(used)
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = got.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.least("root", "vec_id").alias("component_id")).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
