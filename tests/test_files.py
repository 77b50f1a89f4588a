"""Structure-set files of all syntaxes, broken ones, and image headers."""

import struct
import zlib

import pytest

from slicetopo.sources import images, rtstruct

T = rtstruct.TAGS
NAMES = {"": "1.2.840.10008.1.2.1", "implicit": rtstruct.IMPLICIT, "big": rtstruct.BIG, "deflated": rtstruct.DEFLATED}


class Maker:
    """Elements in one syntax."""

    def __init__(self, syntax=""):
        self.syntax, self.order = syntax, ">" if syntax == "big" else "<"

    def __call__(self, tag, kind, value):
        tag = T[tag] if isinstance(tag, str) else tag
        if kind == b"SQ":
            value = b"".join(struct.pack(f"{self.order}HHI", 0xFFFE, 0xE000, len(x)) + x for x in value)
        value += b" " * (len(value) % 2)
        if self.syntax == "implicit":
            return struct.pack("<HHI", *tag, len(value)) + value
        if kind in rtstruct.LONG:
            return struct.pack(f"{self.order}HH2s2xI", *tag, kind, len(value)) + value
        return struct.pack(f"{self.order}HH2sH", *tag, kind, len(value)) + value

    def file(self, data):
        meta = Maker()((2, 16), b"UI", NAMES[self.syntax].encode())
        if self.syntax == "deflated":
            pack = zlib.compressobj(wbits=-15)
            data = pack.compress(data) + pack.flush()
        return b"\0" * 128 + b"DICM" + struct.pack("<HH2sHI", 2, 0, b"UL", 4, len(meta)) + meta + data


def plan(e, patient=b"P1", label=b"Plan", contours=("0\\0\\25\\40\\0\\25\\40\\40\\25",), roi=b"1"):
    rings = [e("contour_type", b"CS", b"CLOSED_PLANAR") + e("contour_data", b"DS", c.encode()) for c in contours]
    data = e("modality", b"CS", b"RTSTRUCT") + e("patient_id", b"LO", patient) + e("study_uid", b"UI", b"1.2\0") + e("label", b"SH", label)
    return data + e("roi_set", b"SQ", [e("roi_number", b"IS", roi) + e("roi_frame", b"UI", b"8.8\0") + e("roi_name", b"LO", b"Heart")]) + e("contour_set", b"SQ", [e("contours", b"SQ", rings) + e("referenced_roi", b"IS", roi)])


@pytest.fixture
def folder(tmp_path):
    e = Maker()
    (tmp_path / "a.dcm").write_bytes(e.file(plan(e)))
    (tmp_path / "b.dcm").write_bytes(e.file(plan(e, patient=b"P2")))
    for s in ("implicit", "big", "deflated"):
        m = Maker(s)
        (tmp_path / f"{s}.dcm").write_bytes(m.file(plan(m, label=s.encode())))
    bad = plan(e, contours=("0\\0\\25\\4x\\0\\25\\40\\40\\25", "0\\0\\35\\40\\0\\35\\40\\40\\35"), label=b"bad")
    (tmp_path / "bad.dcm").write_bytes(e.file(bad))
    (tmp_path / "odd.dcm").write_bytes(e.file(plan(e, roi=b"one", label=b"odd")))
    (tmp_path / "cut.dcm").write_bytes(e.file(plan(e))[:-20])
    (tmp_path / "none.dcm").write_bytes(b"x")
    return tmp_path


def short(path):
    return path.rsplit("/", 1)[1].removesuffix(".dcm")


def test_nothing_merges_and_nothing_dies(spark, folder):
    got = rtstruct.contours(spark, str(folder)).collect()
    assert sorted((short(r.set_id), r.label, r.roi, r.z) for r in got) == [("a", "Plan", 1, 2.5), ("b", "Plan", 1, 2.5), ("bad", "bad", 1, 3.5), ("big", "big", 1, 2.5), ("deflated", "deflated", 1, 2.5), ("implicit", "implicit", 1, 2.5), ("odd", "odd", -1, 2.5)]
    assert all([(p.x, p.y) for p in r.points] == [(0, 0), (4, 0), (4, 4)] for r in got)
    lost = {short(r.path): r.problem for r in rtstruct.problems(spark, str(folder)).collect()}
    assert set(lost) == {"bad", "cut", "none"} and lost["bad"].startswith("1 contours left out: contour 0 of ROI 1")
    assert "ends within" in lost["cut"]
    sets = {short(r.set_id): (r.patient_id, r.study_uid, r.frame) for r in rtstruct.structure_sets(spark, str(folder)).collect()}
    assert sets["a"] == ("P1", "1.2", "8.8") and sets["b"][0] == "P2" and len(sets) == 7
    assert {short(r.set_id): r.name for r in rtstruct.rois(spark, str(folder)).collect()}["big"] == "Heart"


def image(e, frame=b"8.8\0", patient=b"P1", spacing=b"2\\1.5", diameter=b"", pixels=3_000_000):
    number = lambda n: struct.pack(f"{e.order}H", n)
    data = e("modality", b"CS", b"CT") + e("patient_id", b"LO", patient) + e((0x18, 0x1100), b"DS", diameter) + e("study_uid", b"UI", b"1.2\0") + e("frame", b"UI", frame)
    data += e((0x28, 0x10), b"US", number(256)) + e((0x28, 0x11), b"US", number(512)) + e((0x28, 0x30), b"DS", spacing)
    return e.file(data + e((0x7FE0, 0x10), b"OW", b"\0" * pixels))


def test_headers_stop_before_pixels(spark, tmp_path):
    e = Maker()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.dcm").write_bytes(image(e, frame=b"7.7\0"))
    (tmp_path / "x" / "2.dcm").write_bytes(image(e, spacing=b"3\\3"))
    (tmp_path / "3.dcm").write_bytes(image(Maker("big"), patient=b"P3", spacing=b"", diameter=b"400 "))
    (tmp_path / "4.dcm").write_bytes(image(Maker("implicit"), patient=b"P4", spacing=b""))
    (tmp_path / "5.dcm").write_bytes(b"DICM?")
    got = {short(r.path): r for r in images.headers(spark, str(tmp_path)).collect()}
    assert {k: (r.rows, r.columns, r.diameter) for k, r in got.items()} == {"1": (256, 512, None), "2": (256, 512, None), "3": (256, 512, 400.0), "4": (256, 512, None), "5": (None, None, None)}
    assert all(r.bytes_read <= images.FIRST < r.size for k, r in got.items() if k != "5") and got["5"].problem
    sets = spark.createDataFrame([("a", "P1", "1.2", "8.8"), ("b", "P1", "1.2", "none"), ("c", "P3", "1.2", "8.8"), ("d", "P4", "1.2", None), ("e", "P9", "1.2", "8.8")], "set_id string, patient_id string, study_uid string, frame string")
    fallback = spark.createDataFrame([("e", 0.5), ("a", 9.0)], "set_id string, resolution double")
    res = {r.set_id: (r.resolution, r.image and short(r.image)) for r in images.image_resolution(sets, images.headers(spark, str(tmp_path)), fallback).collect()}
    # The own frame first, then by path; 153.6 cm, 76.8, 40 and an assumed 50 over 1,024, rounded up.
    assert {k: i for k, (_, i) in res.items()} == {"a": "2", "b": "1", "c": "3", "d": "4", "e": None}
    assert res["e"][0] == 0.5 and res["a"][0] >= 0.15 and res["b"][0] >= 0.075 and res["c"][0] >= 0.039


def test_long_headers_are_read_in_pieces():
    e = Maker()
    whole = e.file(e((0x9, 0x10), b"UN", b"z" * 100_000) + e("modality", b"CS", b"CT") + e((0x7FE0, 0x10), b"OW", b"\0" * 500_000))

    class Pieces:
        at = 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self, n):
            self.at += n
            return whole[self.at - n : self.at]

    row = images.row_of("p", len(whole), Pieces)
    assert row[1] == "CT" and 100_000 < row[-2] < 400_000
