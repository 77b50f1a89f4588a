"""Image headers as a data source, and the resolution of structure sets from them.

`spark.read.format("image_headers").load(folder)` plans partitions of files from the listing
and reads each file only up to its pixels, a piece at a time; `binaryFile` would load whole
images for a few numbers. Files are opened by their URI (local, HDFS, S3); what is no image
file, or can't be read, has a `problem` and no other value."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import round_one_up
from ..session import ship
from .rtstruct import UNREADABLE, Short, numbers, parse, text

#: Kinds of image files, and those that a resolution is taken from.
IMAGES, SCANS = ("CT", "MR", "PT", "RTIMAGE"), ("CT", "MR", "PT")
SCHEMA = "path string, modality string, patient_id string, study_uid string, frame string, rows int, columns int, row_spacing double, column_spacing double, diameter double, size long, bytes_read long, problem string"
#: Bytes that are read at first, and files of a partition.
FIRST, PER_PARTITION = 16 << 10, 256
#: The assumed diameter in cm where a header has neither spacing nor diameter.
ASSUMED_DIAMETER = 50.0
ROWS, COLUMNS, SPACING, DIAMETER = (0x0028, 0x0010), (0x0028, 0x0011), (0x0028, 0x0030), (0x0018, 0x1100)


def _short(item: dict, tag: tuple[int, int]) -> int | None:
    value = item.get(tag, b"")
    # The byte order of a number this small shows in which byte is the larger.
    return None if len(value) != 2 else int.from_bytes(value, "big" if item.get((0x0002, 0x0010), b"").rstrip(b" \0") == b"1.2.840.10008.1.2.2" else "little")


def _header(open_file, size: int) -> tuple[dict, int]:
    """A file's elements up to its pixels, and the bytes that were read for them: twice as
    many each time until the elements are whole."""
    want = FIRST
    with open_file() as f:
        data = f.read(want)
        while True:
            try:
                return parse(data), len(data)
            except Short:
                if len(data) >= size:
                    raise
                data += f.read(want)
                want *= 2


def row_of(path: str, size: int, open_file) -> tuple:
    try:
        item, n = _header(open_file, size)
        spacing = numbers(item.get(SPACING, b"").decode("ascii", "replace").strip(" \0"))
        wide = numbers(item.get(DIAMETER, b"").decode("ascii", "replace").strip(" \0"))
        row, column = spacing[:2] if len(spacing) >= 2 else (None, None)
        return (path, *(text(item, c) for c in ("modality", "patient_id", "study_uid", "frame")), _short(item, ROWS), _short(item, COLUMNS), row, column, wide[0] if wide else None, size, n, None)
    except (*UNREADABLE, OSError) as e:
        return (path, *(None,) * 9, size, None, f"{type(e).__name__}: {e}")


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(0)
        self.files = files


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".dcm")
        self.per_partition = int(options.get("filesperpartition", PER_PARTITION))

    def partitions(self) -> list[Files]:
        store, base = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.lower().endswith(self.suffix))
        return [Files(found[i : i + self.per_partition]) for i in range(0, len(found), self.per_partition)] or [Files([])]

    def read(self, partition: Files):
        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else fs.LocalFileSystem()
        for path, size in partition.files:
            yield row_of(path, size, lambda p=path: store.open_input_file(p))


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(dict(self.options))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(HeaderSource)
    return spark.read.format("image_headers").load(folder)


def _of(headers_: DataFrame, modalities: tuple[str, ...]) -> DataFrame:
    return headers_.where(F.col("problem").isNull() & F.col("modality").isin(*modalities))


def image_files(spark: SparkSession, folder: str, patient_id: str, study_uid: str | None = None, frame: str | None = None, modalities: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, modality, matches_frame) of a patient's image files, of the study if one is
    named; files of the same frame of reference come first, each group by path."""
    found = _of(headers(spark, folder), modalities).where(F.col("patient_id") == patient_id)
    if study_uid:
        found = found.where(F.col("study_uid") == study_uid)
    same = F.col("frame") == frame if frame else F.lit(False)
    return found.select("path", "modality", same.alias("matches_frame")).orderBy(F.desc("matches_frame"), "path")


def field_of_view() -> Column:
    """The larger side in cm from spacing in mm, else the stored diameter, else an assumed one."""
    sides = F.greatest(F.col("columns") * F.col("column_spacing"), F.col("rows") * F.col("row_spacing")) / 10
    return F.coalesce(sides, F.col("diameter") / 10, F.lit(ASSUMED_DIAMETER))


def image_resolution(sets: DataFrame, headers_: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(set_id, resolution, image): half the distance of pixels, rounded up, from the first
    image of a set's frame of reference, or else of its patient and study, by path. Sets
    without an image take ``fallback`` (set_id, resolution). The best image of a patient, study
    and frame is found first, so no set meets all images of its patient."""
    scans = _of(headers_, SCANS).where("rows is not null and columns > 0")
    value = round_one_up(field_of_view() / (2 * F.col("columns")))
    keys = ["patient_id", "study_uid", "frame"]
    best = scans.groupBy(*keys).agg(F.min(F.struct("path", value.alias("resolution"))).alias("i"))
    met = sets.select("set_id", "patient_id", "study_uid", F.col("frame").alias("own")).join(best, ["patient_id", "study_uid"], "left")
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy(F.when(F.col("own") == F.col("frame"), 0).otherwise(1), "i.path"))
    out = met.withColumn("_k", rank).where("_k = 1").select("set_id", F.col("i.resolution").alias("resolution"), F.col("i.path").alias("image"))
    if fallback is None:
        return out
    return out.join(fallback.select("set_id", F.col("resolution").alias("_f")), "set_id", "left").select("set_id", F.coalesce("resolution", "_f").alias("resolution"), "image")
