"""Structure names: sides, groups, doses, checks and grammars."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def side_tag(name: Column) -> Column:
    """L, R or B at the end, after a space; else empty."""
    return F.regexp_extract(F.trim(name), r" ([LRB])$", 1)


def variant_group(name: Column) -> Column:
    """What names of optimisation and evaluation structures share, in their own spelling;
    null for others. The prefix is followed by a space; a last a, b or c goes."""
    t = F.trim(name)
    rest = F.trim(F.regexp_replace(t, r"(?i)^(opt|eval) ", ""))
    bare = F.trim(F.regexp_replace(rest, r" [abc]$", ""))
    return F.when(t.rlike(r"(?i)^(opt|eval) "), F.nullif(bare, F.lit("")))


def dose_group(name: Column) -> Column:
    """Target family and dose, such as PTV60, wherever they stand in a name; null for others
    and for names of optimisation and evaluation structures."""
    form = r"(?i)(I?[GCPIH]TV)\s*(\d+)(?:[a-c])?\b"
    family = F.regexp_extract(name, form, 1)
    return F.when((family != "") & ~F.trim(name).rlike("(?i)^(opt|eval) "), F.concat(F.upper(family), F.regexp_extract(name, form, 2)))


#: A number as programs write it, and a whole one.
_NUMBER, _WHOLE = r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*", r"\s*[+-]?\d+\s*"
_DOSE = rf"^({_NUMBER})(Gy)?(?:x({_WHOLE}))?$"


def dose_fractions(text: Column) -> Column:
    """The number of fractions after the x of a dose; null without one, or for other text."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit("p"), F.lit(".")), _DOSE, 3), F.lit("")).try_cast("int")


def dose_to_cgy(text: Column) -> Column:
    """The total dose in cGy: a number, in gray before Gy, with p or a point for decimals, times
    the fractions after an x, if there are any; other text as it is."""
    t = F.replace(text, F.lit("p"), F.lit("."))
    number = F.trim(F.regexp_extract(t, _DOSE, 1)).try_cast("double")
    one = F.when(F.regexp_extract(t, _DOSE, 2) == "Gy", number * 100).otherwise(number)
    times = dose_fractions(text)
    total = F.round(F.when(times != 0, one * times).otherwise(one), 6).cast("decimal(38,6)").cast("string")
    return F.when(t.rlike(_DOSE), F.regexp_replace(total, r"\.?0+$", "")).otherwise(text)


def checks(name: Column, times: Column) -> dict[str, Column]:
    """Nomenclature checks; ``times``: how often the name occurs in its set in any case."""
    return {"short_enough": F.length(name) <= 16, "no_spaces": ~name.contains(" "), "no_duplicate": times == 1, "hidden": name.rlike("^[zZ_]")}


def strip_upload_prefix(name: Column) -> Column:
    """File names without the identifiers and words that uploading puts in front."""
    one = r"(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|upload)_"
    return F.regexp_replace(name, rf"^(?:{one})+(?=.)", "")


def swap_ab(text: Column) -> Column:
    """The words A and B exchanged, but in "A and B" and "B and A"."""
    t = F.replace(F.replace(text, F.lit("A and B"), F.lit("\u0001")), F.lit("B and A"), F.lit("\u0003"))
    for a, b in ((r"\bA\b", "\u0002"), (r"\bB\b", "A"), ("\u0002", "B"), ("\u0001", "A and B"), ("\u0003", "B and A")):
        t = F.regexp_replace(t, a, b)
    return t


#: Grammars by kind of name; named groups become columns.
GRAMMARS = {
    "target": r"^(?P<prefix>opt|eval|z|_)?[ _]?(?P<family>I?[GCPIH]TV)(?P<kind>[npsv])?[_ ]?(?P<number>\d{1,2}(?!\d))?[_ ]?(?P<dose>\d{3,5})?(?P<part>[a-c])?",
    "organ": r"^(?P<prefix>opt|eval|z|_)?[ _]?(?P<organ>[A-Za-z]+?)(?:_(?P<region>[A-Z][a-z]+))?(?:[_ ](?P<side>[LRB]))?(?:_PRV(?P<margin>\d{1,2})?)?$",
    "margin": r"(?P<base>.+?)(?P<sign>[+-])(?P<size>\d+(?:\.\d+)?)\s*(?P<unit>mm|cm)?$",
}


def parse_name(name: Column, grammar: str) -> dict[str, Column]:
    """A column for each named group; null where the name does not match."""
    pattern = GRAMMARS[grammar]
    groups = re.compile(pattern).groupindex
    java = re.sub(r"\(\?P<", "(?<", pattern)
    return {g: F.when(F.trim(name).rlike(f"(?i){java}"), F.nullif(F.regexp_extract(F.trim(name), f"(?i){java}", i), F.lit(""))) for g, i in groups.items()}


def sort_rank(value: Column, order: list[str] | None = None, missing_last: bool = True) -> Column:
    """Place of a value in a list; values outside it come after, nulls first or last."""
    edge = (len(order or []) + 2) if missing_last else 0
    if order is None:
        return F.when(value.isNull(), edge)
    return F.when(value.isNull(), F.lit(edge)).otherwise(F.when(F.array_position(F.array(*map(F.lit, order)), value) > 0, F.array_position(F.array(*map(F.lit, order)), value)).otherwise(F.lit(len(order) + 1))).cast("int")


#: Target families in the order in which they are listed, and sides.
FAMILIES, SIDES = ("GTV", "CTV", "ITV", "PTV"), ("L", "R", "B")


def order_of(name: Column) -> Column:
    """Struct (kind, first, second, third, fourth) by which names are listed: targets by family,
    dose, number and part, then organs by name, region and side, then names with a margin by
    what it is put on and its size; names that no grammar takes come last, by themselves."""
    t, m, o = (parse_name(name, g) for g in ("target", "margin", "organ"))
    kind = F.when(t["family"].isNotNull(), 0).when(m["size"].isNotNull(), 2).when(o["organ"].isNotNull(), 1).otherwise(3)
    word = lambda x: F.coalesce(F.lower(x), F.lit(""))
    number = lambda x: F.lpad(F.coalesce(x, F.lit("0")), 8, "0")
    place = lambda x, order: F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.upper(x)), F.lit(0)).cast("string")
    pick = lambda *of: F.when(kind == 0, of[0]).when(kind == 1, of[1]).when(kind == 2, of[2]).otherwise(of[3])
    none = F.lit("")
    family = F.concat(F.lpad(F.when(F.array_contains(F.array(*map(F.lit, FAMILIES)), F.upper(t["family"])), place(t["family"], FAMILIES)).otherwise("9"), 1, "0"), word(t["family"]))
    first = pick(family, word(o["organ"]), word(m["base"]), word(name))
    second = pick(number(t["dose"]), word(o["region"]), F.coalesce(m["sign"], none), none)
    third = pick(number(t["number"]), place(o["side"], SIDES), number(F.regexp_replace(m["size"], r"\..*", "")), none)
    return F.struct(kind.alias("kind"), first.alias("first"), second.alias("second"), third.alias("third"), pick(word(t["part"]), number(o["margin"]), word(m["unit"]), none).alias("fourth"))
