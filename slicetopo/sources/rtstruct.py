"""Structure-set files and image headers.

Files are listed and read by Spark (`binaryFile`), so any store that Spark knows works.
Data elements with their sequences are parsed in either byte order, with explicit or implicit
value types, deflated or not. A structure set is a file: its ``set_id`` is the path, as labels
repeat everywhere. What can't be read is left out of its file, never fails the job, and is
listed by :func:`problems`. Image headers come from :mod:`images`, which reads no pixels.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import strip_upload_prefix
from ..session import ship

LONG = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"OL", b"UC", b"UR"}
#: Tags that are read.
TAGS = {
    "modality": (0x0008, 0x0060), "study_uid": (0x0020, 0x000D), "series_number": (0x0020, 0x0011), "series_description": (0x0008, 0x103E), "study_id": (0x0020, 0x0010),
    "patient_name": (0x0010, 0x0010), "patient_id": (0x0010, 0x0020), "label": (0x3006, 0x0002),
    "roi_set": (0x3006, 0x0020), "roi_number": (0x3006, 0x0022), "roi_name": (0x3006, 0x0026), "generation": (0x3006, 0x0036),
    "contour_set": (0x3006, 0x0039), "contours": (0x3006, 0x0040), "contour_type": (0x3006, 0x0042), "contour_data": (0x3006, 0x0050), "referenced_roi": (0x3006, 0x0084), "color": (0x3006, 0x002A),
    "observations": (0x3006, 0x0080), "roi_type": (0x3006, 0x00A4), "observation_label": (0x3006, 0x0085),
    "generation_text": (0x3006, 0x0038), "codes": (0x3006, 0x0086), "code": (0x0008, 0x0100), "scheme": (0x0008, 0x0102), "meaning": (0x0008, 0x0104),
    "frame": (0x0020, 0x0052), "roi_frame": (0x3006, 0x0024),
    "properties": (0x3006, 0x00B0), "property": (0x3006, 0x00B2), "property_value": (0x3006, 0x00B4),
}
CONTOURS = "path string, set_id string, label string, roi int, z double, contour_no int, points array<struct<x:double,y:double>>"
ROIS = "path string, set_id string, label string, roi int, name string, generation_method string, generation_description string, color array<int>"
OBSERVATIONS = "path string, set_id string, roi int, structure_name string, roi_type string, code string, coding_scheme string, code_meaning string, physical_property string, density string"
PROBLEMS = "path string, problem string"
SETS = "path string, set_id string, modality string, patient_name string, patient_id string, label string, study_id string, series_number string, series_description string, study_uid string, frame string"


#: Transfer syntaxes that differ from little-endian with explicit types.
IMPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
SYNTAX, PIXELS = (0x0002, 0x0010), (0x7FE0, 0x0010)
UNDEFINED = 0xFFFFFFFF
#: Sequences among the tags; without value types nothing else tells them from other elements.
SEQUENCES = {TAGS[n] for n in ("roi_set", "contour_set", "contours", "observations", "codes", "properties")}


class Short(ValueError):
    """The data end before their element does."""


@dataclass(frozen=True)
class Syntax:
    order: str = "<"
    implicit: bool = False

    def head(self, data: bytes, at: int) -> tuple[tuple[int, int], bool, int, int]:
        """Tag, whether it is a sequence, size and start of the value of the element at a place."""
        tag = struct.unpack_from(f"{self.order}HH", data, at)
        if self.implicit:
            size = struct.unpack_from(f"{self.order}I", data, at + 4)[0]
            return tag, tag in SEQUENCES or size == UNDEFINED, size, at + 8
        kind = data[at + 4 : at + 6]
        if kind in LONG:
            size = struct.unpack_from(f"{self.order}I", data, at + 8)[0]
            return tag, kind == b"SQ" or (kind == b"UN" and size == UNDEFINED), size, at + 12
        return tag, False, struct.unpack_from(f"{self.order}H", data, at + 6)[0], at + 8


def elements(data: bytes, at: int, end: int, syntax: Syntax = Syntax()) -> tuple[dict, int]:
    """Elements from ``at`` on, up to pixels: text as bytes, sequences as lists of such
    dictionaries."""
    out: dict = {}
    while at + 8 <= end:
        if struct.unpack_from(f"{syntax.order}HH", data, at) in ((0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)):
            return out, at + 8
        tag, sequence, size, at = syntax.head(data, at)
        if tag == PIXELS:
            return out, end
        if sequence:
            items, stop = [], end if size == UNDEFINED else at + size
            if stop > len(data):
                raise Short(f"the file ends within {tag[0]:04x},{tag[1]:04x}")
            while at + 8 <= stop:
                group, number, n = struct.unpack_from(f"{syntax.order}HHI", data, at)
                at += 8
                if (group, number) != (0xFFFE, 0xE000):
                    break
                item, after = elements(data, at, stop if n == UNDEFINED else at + n, syntax)
                items.append(item)
                at = after if n == UNDEFINED else at + n
            out[tag] = items
            at = stop if size != UNDEFINED else at
        else:
            if size == UNDEFINED or at + size > len(data):
                raise Short(f"the file ends within {tag[0]:04x},{tag[1]:04x}")
            out[tag] = data[at : at + size]
            at += size
    return out, at


def parse(content: bytes) -> dict:
    """A file's elements; ValueError for what is no such file."""
    if content[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    size = struct.unpack_from("<I", content, 140)[0]  # group length of the file meta information
    if 144 + size > len(content):
        raise Short("the file ends within its first group")
    meta, _ = elements(content, 132, 144 + size)
    name = meta.get(SYNTAX, b"").decode("ascii", "replace").strip(" \0")
    syntax = Syntax(">" if name == BIG else "<", name == IMPLICIT)
    if name == DEFLATED:
        body = zlib.decompress(content[144 + size :], -15)
        return elements(body, 0, len(body), syntax)[0] | meta
    return elements(content, 144 + size, len(content), syntax)[0] | meta


def text(item: dict, name: str) -> str:
    value = item.get(TAGS[name], b"")
    return value.decode("utf-8", "replace").strip(" \0") if isinstance(value, bytes) else ""


def whole(item: dict, name: str) -> int:
    """A number, -1 if there is none."""
    value = text(item, name)
    return int(value) if re.match(r"[+-]?\d+$", value) else -1


def numbers(value: str) -> list[float]:
    return [float(x) for x in value.split("\\") if x.strip()]


def contour_rows(item: dict, scale: float = 0.1, bad: list[str] | None = None) -> Iterator[tuple]:
    """(roi, z, contour number, points in cm) of the closed planar contours of three points
    or more. ``bad`` takes what is wrong with contours that can't be read."""
    for roi in item.get(TAGS["contour_set"], []):
        number = whole(roi, "referenced_roi")
        for k, c in enumerate(roi.get(TAGS["contours"], [])):
            try:
                v = [x * scale for x in numbers(text(c, "contour_data"))]
            except ValueError as e:
                if bad is not None:
                    bad.append(f"contour {k} of ROI {number}: {e}")
                continue
            if text(c, "contour_type") == "CLOSED_PLANAR" and len(v) >= 9:
                yield number, v[2], k, [{"x": x, "y": y} for x, y in zip(v[::3], v[1::3], strict=False)]


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dcm").load(folder).select("path", "content")


#: What unreadable bytes raise when they are parsed.
UNREADABLE = (ValueError, IndexError, struct.error, zlib.error, AttributeError, TypeError, RecursionError)


def _each(rows_of):
    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    item = parse(bytes(content))
                    if "RTSTRUCT" in text(item, "modality"):
                        out += rows_of(path, item)
                except UNREADABLE:
                    continue  # :func:`problems` lists them
            yield out

    return run


def _frames(rows_of, schema: str):
    names = [c.split(" ")[0] for c in schema.replace("array<struct<x:double,y:double>>", "points").split(", ")]
    return lambda it: (pd.DataFrame(rows, columns=names) for rows in _each(rows_of)(it))


def _problem(path: str, content: bytes) -> str | None:
    bad: list[str] = []
    try:
        item = parse(content)
        if "RTSTRUCT" not in text(item, "modality"):
            return f"no structure set but {text(item, 'modality') or 'nothing known'}"
        n = sum(1 for _ in contour_rows(item, bad=bad))
        for rows in (_roi_rows, _observation_rows):
            rows(path, item)
    except UNREADABLE as e:
        return f"unreadable: {e}"
    if bad:
        return f"{len(bad)} contours left out: {'; '.join(bad[:5])}"
    return None if n else "no closed planar contour of three points"


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """(path, problem) of every file that gives no contours, and of those that some were left
    out of, so that nothing vanishes."""
    ship(spark)

    def run(batches):
        for b in batches:
            rows = [(p, _problem(p, bytes(c))) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["path", "problem"])

    return files(spark, folder).mapInPandas(run, PROBLEMS)


def contours(spark: SparkSession, folder: str) -> DataFrame:
    """Contours of all structure sets of a folder."""
    ship(spark)
    rows = lambda path, item: [(path, path, text(item, "label"), *r) for r in contour_rows(item)]
    return files(spark, folder).mapInPandas(_frames(rows, CONTOURS), CONTOURS)


def _roi_rows(path: str, item: dict) -> list[tuple]:
    colors = {text(c, "referenced_roi"): [int(v) for v in numbers(text(c, "color"))] for c in item.get(TAGS["contour_set"], [])}
    return [(path, path, text(item, "label"), whole(r, "roi_number"), text(r, "roi_name"), text(r, "generation"), text(r, "generation_text"), colors.get(text(r, "roi_number")) or None) for r in item.get(TAGS["roi_set"], [])]


def _observation_rows(path: str, item: dict) -> list[tuple]:
    out = []
    for o in item.get(TAGS["observations"], []):
        code, held = ((o.get(TAGS[n]) or [{}])[0] for n in ("codes", "properties"))
        kind = text(held, "property")
        density = text(held, "property_value") if "DENSITY" in kind else ""
        out.append((path, path, whole(o, "referenced_roi"), text(o, "observation_label"), text(o, "roi_type"), text(code, "code"), text(code, "scheme"), text(code, "meaning"), kind, density))
    return out


def rois(spark: SparkSession, folder: str) -> DataFrame:
    """Names, origin and display colour of all ROIs."""
    ship(spark)
    return files(spark, folder).mapInPandas(_frames(_roi_rows, ROIS), ROIS)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Labels, types, the first code, and the physical property of all observed ROIs."""
    ship(spark)
    return files(spark, folder).mapInPandas(_frames(_observation_rows, OBSERVATIONS), OBSERVATIONS)


def structure_sets(spark: SparkSession, folder: str) -> DataFrame:
    """A row per structure set, sorted by label, patient and path, in any case."""
    ship(spark)
    names = ("modality", "patient_name", "patient_id", "label", "study_id", "series_number", "series_description", "study_uid")
    rows = lambda path, item: [(path, path, *(text(item, n) for n in names), next((f for r in item.get(TAGS["roi_set"], []) if (f := text(r, "roi_frame"))), text(item, "frame")))]
    out = files(spark, folder).mapInPandas(_frames(rows, SETS), SETS)
    name = strip_upload_prefix(F.element_at(F.split("path", "/"), -1))
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), F.lit("^" + re.escape(folder.rstrip("/")) + "/"), F.lit(""))
    out = out.withColumn("last_name", F.substring_index("patient_name", "^", 1)).withColumn("file", name).withColumn("relative_path", inside)
    return out.orderBy(F.lower("label"), F.lower("patient_id"), F.lower("relative_path"))


def filter_metadata(rois_: DataFrame, observations_: DataFrame, contours_: DataFrame) -> DataFrame:
    """One row per ROI that is named or observed, with what filter rules read, by number."""
    keys = ["set_id", "roi"]
    n = contours_.groupBy(*keys).agg(F.count("*").alias("n"))
    both = rois_.select(*keys, "name", "generation_method", "generation_description").join(observations_.drop("path"), keys, "full_outer").join(n, keys, "left")
    named = {"Structure ID": "name", "Structure Name": "structure_name", "DICOM Type": "roi_type", "Code": "code", "Coding Scheme": "coding_scheme", "Code Meaning": "code_meaning", "ROI Physical Property": "physical_property", "Density": "density", "Generation Method": "generation_method", "Generation Description": "generation_description"}
    out = both.select(*keys, *[F.coalesce(c, F.lit("")).alias(k) for k, c in named.items()], F.coalesce("n", F.lit(0)).alias("Contour Count"), F.col("n").isNotNull().alias("Has Contours"))
    return out.orderBy("set_id", "roi")
