"""Columns of 9- and 27-bit relations: building, showing, transposing, adjusting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

II, IB, IE, BI, BB, BE, EI, EB, EE = (1 << (8 - i) for i in range(9))
BANDS = (18, 9, 0)
#: Only A, or only B, has something on a slice; the same in each band.
ONLY_A = sum((IE | BE | EE) << b for b in BANDS)
ONLY_B = sum((EI | EB | EE) << b for b in BANDS)
SWAPS = ((IB, BI), (IE, EI), (BE, EB))


def matrix(**cells: Column) -> Column:
    """9 bits from boolean columns named II, IB and so on; EE is always set."""
    values = {"II": II, "IB": IB, "IE": IE, "BI": BI, "BB": BB, "BE": BE, "EI": EI, "EB": EB}
    out = F.lit(EE)
    for name, cell in cells.items():
        out = out + F.when(cell, F.lit(values[name])).otherwise(F.lit(0))
    return out.cast("int")


def bands(region: Column, exterior: Column, hull: Column) -> Column:
    return (F.shiftleft(region, 18) + F.shiftleft(exterior, 9) + hull).cast("int")


def _move(bits: Column, source: int, target: int) -> Column:
    return F.when(bits.bitwiseAND(F.lit(source)) != 0, F.lit(target)).otherwise(F.lit(0))


def transpose(bits: Column, width: int = 27) -> Column:
    """Rows and columns exchanged in every band."""
    shifts = BANDS if width == 27 else (0,)
    keep = sum((II | BB | EE) << s for s in shifts)
    out = bits.bitwiseAND(F.lit(keep))
    for s in shifts:
        for a, b in SWAPS:
            out = out + _move(bits, a << s, b << s) + _move(bits, b << s, a << s)
    return out.cast("int")


def adjust_boundary(region9: Column, of_a: bool, of_b: bool) -> Column:
    """27 bits of a boundary slice: of the region band only II stays, as BI, IB or BB."""
    target = BB if of_a and of_b else BI if of_a else IB if of_b else II
    return F.shiftleft(_move(region9, II, target), 18).cast("int")


def adjust_hole(region9: Column, of_a: bool) -> Column:
    """27 bits for a hole's polygon: its inside is outside. Interiors become exteriors,
    and the interior row (of A) or column (of B) is emptied."""
    rows = ((II, EI), (IB, EB), (IE, EE)) if of_a else ((II, IE), (BI, BE), (EI, EE))
    drop = (EI | EB | EE) if of_a else (IE | BE | EE)
    keep = 511 & ~(sum(a for a, _ in rows) | drop)
    out = region9.bitwiseAND(F.lit(keep))
    for a, b in rows:
        out = out + _move(region9, a, b)
    return F.shiftleft(out.cast("int"), 18).cast("int")


def to_text(bits: Column, width: int = 27) -> Column:
    """Zeros and ones, most significant first; null where bits do not fit."""
    return F.when((bits >= 0) & (bits < F.lit(1 << width)), F.lpad(F.bin(bits), width, "0"))


def from_text(text: Column) -> Column:
    """Bits of a DE-9IM string or a string of such bands: F, 0 and a point contact are 0."""
    flat = F.translate(F.translate(text, "F2", "01"), "*", "0")
    return F.conv(flat, 2, 10).cast("int")


def to_matrix(bits: Column) -> Column:
    """The three matrices, side by side on three lines."""
    text = to_text(bits)
    row = lambda k: F.concat_ws(" ", *[F.substr(text, F.lit(b * 9 + k * 3 + 1), F.lit(3)) for b in range(3)])
    return F.concat_ws("\n", row(0), row(1), row(2))
