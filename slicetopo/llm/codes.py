"""Operator 13, vector code compression: a product quantizer in whole numbers, trained by
treeAggregate over columnar blocks.

A component x counts as floor(4096 x). A vector is cut into ``PARTS`` equal parts, each with
a codebook of ``ENTRIES`` entries that starts as that part of the smallest vec_ids. A round
assigns every part to the nearest entry and moves the entry to floor(sum / count) of its
parts; an entry without parts stays. All sums are whole numbers, so neither the order of
rows nor that of merges changes the result.

Rows are packed once into blocks of integers, component by component, and written. A round
is one treeAggregate over the blocks: distances accumulate component by component, parts are
added to tensors of sums and counts, and the tensors merge through a reduction tree. Tensors
and codebooks have a fixed size, entries times components, whatever the number of rows.

Vectors that are null or hold null or non-finite components are dropped. A length that the
number of parts does not divide is filled up with zeros, which change no distance; empty
vectors have the code of zeros and error 0. Vectors of different lengths are quantized apart,
each length with its own codebooks; the codebooks of all lengths together may hold
``MOST_NUMBERS`` numbers. Fewer vectors than entries make fewer entries. Rows with equal
vec_ids are ordered by their components, a null vec_id comes last, and repeated rows count
as often as they stand. Components beyond 2^24 steps are reckoned in unbounded integers; an
error that a long cannot hold is given as the largest long. Other columns are not read."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, salted_join, tune

PARTS, ENTRIES, ROUNDS, STEPS = 8, 16, 6, 4096
#: Steps up to which squares and sums of rows stay within a long.
SAFE = 2**24
MOST_NUMBERS, LAST = 2**24, 2**63 - 1


def whole(rows: list, steps: int = STEPS) -> np.ndarray:
    """floor(steps * x) of vectors of one length, as longs, or as Python's integers where a
    component is large."""
    x = np.array(rows, dtype=np.float64).reshape(len(rows), -1)
    if x.size == 0 or np.abs(x).max() <= SAFE / steps:
        return np.floor(x * steps).astype(np.int64)
    return np.array([[math.floor(v * steps) if abs(v) < 2**52 else int(v) * steps for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)


def parts_of(values: np.ndarray, parts: int) -> np.ndarray:
    """[part, component, row] of [row, component]; zeros fill up the last part."""
    n, length = values.shape
    short = -length % parts
    if short:
        values = np.concatenate([values, np.zeros((n, short), dtype=values.dtype)], axis=1)
    return np.ascontiguousarray(values.reshape(n, parts, -1).transpose(1, 2, 0))


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries [part, row] and their squared distances. ``books``: [part, entry,
    component]; of equally near entries the first."""
    kind = object if object in (block.dtype, books.dtype) else np.int64
    far = np.zeros((block.shape[0], books.shape[1], block.shape[2]), dtype=kind)
    for j in range(block.shape[1]):
        gap = block[:, None, j, :] - books[:, :, j, None]
        far += gap * gap
    near = far.argmin(axis=1)
    return near, np.take_along_axis(far, near[:, None, :], axis=1)[:, 0, :]


def tensors(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums [part, entry, component] and counts [part, entry] of the parts by their entries."""
    near, _ = assign(block, books)
    sums, counts = np.zeros(books.shape, dtype=block.dtype), np.zeros(books.shape[:2], dtype=np.int64)
    for p in range(len(books)):
        np.add.at(sums[p], near[p], block[p].T)
        np.add.at(counts[p], near[p], 1)
    return sums, counts


def merge(a: dict, b: dict) -> dict:
    for length, (sums, counts) in b.items():
        if length in a:
            a[length] = a[length][0] + sums, a[length][1] + counts
        else:
            a[length] = sums, counts
    return a


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    used = np.maximum(counts, 1)[:, :, None]
    return np.where(counts[:, :, None] > 0, sums // used, books)


def _pack(batches):
    """Blocks of vectors of one length; large numbers travel as text."""
    for b in batches:
        by_length: dict[int, list] = {}
        for v in b.column("embedding").to_pylist():
            by_length.setdefault(len(v), []).append(v)
        blocks = {n: parts_of(whole(v), PARTS) for n, v in by_length.items() if n}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), type=pa.int32()), pa.array([x.dtype == object for x in blocks.values()], type=pa.bool_()), pa.array([x.shape[2] for x in blocks.values()], type=pa.int32()), pa.array([",".join(map(str, x.ravel())).encode() if x.dtype == object else x.tobytes() for x in blocks.values()], type=pa.binary())],
            names=["length", "large", "n", "block"],
        )


def _block(row) -> np.ndarray:
    shape = (PARTS, -1, row.n)
    if row.large:
        return np.array([int(x) for x in bytes(row.block).split(b",")], dtype=object).reshape(shape)
    return np.frombuffer(row.block, dtype=np.int64).reshape(shape)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, length) of the vectors that count, in double precision."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "label", x.alias("embedding")).where(F.col("embedding").isNotNull() & sound)
    return rows.withColumn("length", F.size("embedding"))


def first_books(rows: DataFrame) -> dict[int, np.ndarray]:
    """The codebooks to start with, by length. Spark keeps a length's smallest rows in every
    task before it shuffles them."""
    by_id = Window.partitionBy("length").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    numbers = rows.groupBy("length").count().agg(F.sum(F.col("length").cast("long") * ENTRIES)).first()[0] or 0
    if numbers > MOST_NUMBERS:
        raise ValueError(f"codebooks of all lengths hold {numbers} numbers, more than {MOST_NUMBERS}")
    least = rows.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= ENTRIES).select("length", "rank", "embedding").collect()
    found: dict[int, list] = {}
    for r in sorted(least, key=lambda r: r["rank"]):
        found.setdefault(r["length"], []).append(r["embedding"])
    return {n: parts_of(whole(v), PARTS).transpose(0, 2, 1) for n, v in found.items() if n}


def train(rows: DataFrame) -> dict[int, np.ndarray]:
    """Codebooks [part, entry, component] of every length. Each round is one treeAggregate
    over written blocks, so a lost executor costs its blocks of that round only."""
    books = first_books(rows)
    if not books:
        return books
    packed = cut(rows.select("embedding").mapInArrow(_pack, "length int, large boolean, n int, block binary"))
    blocks = packed.rdd

    for _ in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(books)

        def add(found: dict, row, shared=shared) -> dict:
            return merge(found, {row.length: tensors(_block(row), shared.value[row.length])})

        got = blocks.treeAggregate({}, add, merge, depth=3)
        books = {n: moved(b, *got[n]) for n, b in books.items()}
        shared.unpersist()
    drop(packed)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _encode(shared):
    def run(batches):
        books = shared.value
        names = {n: digest(b) for n, b in books.items()}
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            vectors = b.column("embedding").to_pylist()
            code, error = ["00" * PARTS] * len(vectors), [0] * len(vectors)
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if v:
                    by_length.setdefault(len(v), []).append(i)
            for n, at in by_length.items():
                near, far = assign(parts_of(whole([vectors[i] for i in at]), PARTS), books[n])
                for i, entries, e in zip(at, near.T.tolist(), far.sum(axis=0).tolist(), strict=True):
                    code[i], error[i] = "".join(f"{x:02x}" for x in entries), min(e, LAST)
            sha = [names[len(v)] if v else empty for v in vectors]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, type=pa.string()), pa.array(error, type=pa.int64()), pa.array(sha, type=pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), a row for every vector
    that counts. Errors of a label are summed before they are shuffled, and the rows of a
    label that has many are dealt over tasks."""
    spark = vectors.sparkSession
    tune(spark)
    rows = usable(vectors)
    shared = spark.sparkContext.broadcast(train(rows))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = cut(rows.select("vec_id", "label", "embedding").mapInArrow(_encode(shared), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long, codebooks_sha256 string"))
    coded = coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = cut(coded.groupBy("_none", "_label").agg(F.least(total, F.lit(LAST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n")))
    out = salted_join(coded, sums.drop("n"), ["_none", "_label"], sums.select("_none", "_label", "n"), ["vec_id"])
    return out.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
