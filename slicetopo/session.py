"""What a session needs: the package on its executors, and a folder that all share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="slicetopo-"), "slicetopo.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("slicetopo", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a temporary folder is
    set on a local master; on a cluster each machine would have its own, so this raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slicetopo-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The application's part of the shared folder; all its tables between steps are there."""
    return f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete the application's tables between steps, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the run's folder: what several steps read is made once, and a
    lost executor costs no recomputation before it."""
    path = f"{run_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over all cores, twice at least. Geometry is small in bytes and long in
    work; a shuffle whose number of tasks follows from bytes would put it into one task."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
