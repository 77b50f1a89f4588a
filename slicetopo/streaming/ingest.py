"""Structure sets that arrive as a stream of files.

A set may arrive in several batches, in any order, and files may arrive twice. The stream is
keyed by set: Spark's state store holds the structures of a set that have arrived, and a
batch reads the state of its own sets only, however many batches there were. A structure is
taken once; it is paired with all of its set so far, and the bits of the pairs follow from
closed forms in the JVM. Pairs are appended once each, exactly once by the file sink, and
slice bits merge with a bitwise or, so the result does not depend on how sets were cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import boxes as B
from ..plans import definitions as D
from ..session import run_folder, ship

#: Columns of a box, as the state holds them one after the other.
BOX = ("roi", "x0", "x1", "y0", "y1", "z0", "z1", "volume")
PAIRS = "set_id long, " + ", ".join(f"{side}_{c} long" for side in "ab" for c in BOX)


def pair_arrivals(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pairs of a set with a structure that is new to it, the larger one first."""
    known = np.array(state.get[0] if state.exists else [], dtype=np.int64).reshape(-1, len(BOX))
    come = np.concatenate([r[list(BOX)].to_numpy(dtype=np.int64) for r in rows])
    _, first = np.unique(come[:, 0], return_index=True)
    new = come[np.sort(first)]
    new = new[~np.isin(new[:, 0], known[:, 0])]
    if not len(new):
        return
    every = np.concatenate([known, new])
    state.update((every.ravel().tolist(),))
    # By falling volume, then by number.
    order = np.lexsort((every[:, 0], -every[:, 7]))
    every, fresh = every[order], (order >= len(known))
    for i in range(len(every) - 1):
        j = np.arange(i + 1, len(every))
        j = j if fresh[i] else j[fresh[j]]
        if len(j):
            pairs = np.concatenate([np.full((len(j), 1), key[0]), np.repeat(every[i : i + 1], len(j), axis=0), every[j]], axis=1)
            yield pd.DataFrame(pairs, columns=[c.split()[0] for c in PAIRS.split(", ")])


def relate_arrivals(boxes: DataFrame) -> DataFrame:
    """(set_id, roi_a, roi_b, bits) of a stream of boxes: each pair once, when its second
    structure has arrived."""
    pairs = boxes.select("set_id", *BOX).groupBy("set_id").applyInPandasWithState(pair_arrivals, PAIRS, "boxes array<long>", "append", GroupStateTimeout.NoTimeout)
    sides = pairs.select("set_id", *[F.struct(*[F.col(f"{x}_{c}").alias(c) for c in BOX]).alias(x) for x in "ab"])
    return sides.select("set_id", F.col("a.roi").alias("roi_a"), F.col("b.roi").alias("roi_b"), B.pair_bits("a", "b").alias("bits"))


def ingest(spark: SparkSession, folder: str, name: str, target: str, files_at_once: int | None = None) -> StreamingQuery:
    """Starts a query that relates the structures of all files called ``name`` (a pattern) that
    a folder has and has not been read yet. ``target`` keeps results and state, so a later
    call goes on where this one ended."""
    ship(spark)
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)
    related = relate_arrivals(B.solid_boxes(stream.parquet(folder)))
    return related.writeStream.format("parquet").outputMode("append").option("path", f"{target}/bits").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()


def merged(spark: SparkSession, target: str) -> DataFrame:
    """Relations of all pairs so far."""
    bits = spark.read.schema("set_id long, roi_a long, roi_b long, bits int").parquet(f"{target}/bits")
    return bits.groupBy("set_id", "roi_a", "roi_b").agg(F.bit_or("bits").alias("bits")).withColumn("relation", D.classify(F.col("bits")))


def relations_by_stream(spark: SparkSession, folder: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """Pair relations of all structures of the files called ``name`` in a folder, read as a
    stream."""
    target = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    ingest(spark, folder, name, target, files_at_once).awaitTermination()
    return merged(spark, target)
