"""Whether relation definitions are sound: cubes of bits, and a report of all checks.

A definition is a cube: the patterns of 27 bits that have its value under its mask. Two
cubes meet where their values agree on the bits that both look at; a pattern in two cubes
would have two names, so a set of definitions must have no overlap. Taking all cubes from the whole
space leaves what no definition names.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import swap_ab
from .definitions import DEFINITIONS, Cube, Definition, meet, test_of, transpose_int

WIDTH = 27


def without(p: Cube, q: Cube) -> list[Cube]:
    """Disjoint cubes that hold what is in the first and not in the second."""
    if meet(p, q) is None:
        return [p]
    out, (mask, value) = [], p
    for i in range(WIDTH):
        bit = 1 << i
        if q[0] & bit and not mask & bit:
            out.append((mask | bit, value | (~q[1] & bit)))
            mask, value = mask | bit, value | (q[1] & bit)
    return out


def size(p: Cube) -> int:
    return 1 << (WIDTH - p[0].bit_count())


def uncovered(definitions: list[Definition] = DEFINITIONS) -> list[Cube]:
    """Disjoint cubes of the patterns that no definition with a test names."""
    left: list[Cube] = [(0, 0)]
    for d in definitions:
        if d.mask:
            left = [r for p in left for r in without(p, (d.mask, d.value))]
    return left


def overlap_table(defs: DataFrame) -> DataFrame:
    """(set_id if there is one, first, second, mask, value, n_patterns) of overlapping
    definitions, as a join of a table of definitions with itself: for checking many catalogues
    of definitions at once."""
    keys = [c for c in ("set_id",) if c in defs.columns]
    side = lambda x: defs.where("mask <> 0").select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in ("relation_type", "mask", "value")])
    joined = side("a").join(side("b"), keys) if keys else side("a").join(side("b"), F.lit(True))
    agree = F.col("value_a").bitwiseXOR(F.col("value_b")).bitwiseAND(F.col("mask_a")).bitwiseAND(F.col("mask_b")) == 0
    mask = F.col("mask_a").bitwiseOR(F.col("mask_b"))
    met = joined.where((F.col("relation_type_a") < F.col("relation_type_b")) & agree)
    return met.select(*keys, F.col("relation_type_a").alias("first"), F.col("relation_type_b").alias("second"), mask.alias("mask"), F.col("value_a").bitwiseOR(F.col("value_b")).alias("value"), F.pow(F.lit(2.0), F.lit(WIDTH) - F.bit_count(mask)).cast("long").alias("n_patterns"))


def matches(bits: Column, definitions: list[Definition] = DEFINITIONS) -> Column:
    """Names of all definitions that hold, in order; one at most if they are sound."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(d.mask)) == F.lit(d.value), F.lit(d.name)) for d in definitions if d.mask]))


# ---- the report ------------------------------------------------------------------

#: Fields that every definition has, and their types where one is set.
REQUIRED = ("relation_type", "label", "symbol", "symmetric", "transitive", "pattern", "mask", "value", "complementary_relation")
TYPES = {"symmetric": bool, "transitive": bool, "reversed_arrow": bool, "examples": list}
DEPRECATED = ("mask_decimal", "value_decimal")

Found = Iterator[tuple[str, str]]
CHECKS: dict[str, Callable[[list[dict], dict[str, dict]], Found]] = {}


def _check(f):
    CHECKS[f.__name__.strip("_")] = f
    return f


def _name(d: dict) -> str:
    return str(d.get("relation_type", ""))


def _bits(d: dict, field: str) -> int | None:
    """A binary field as a number, None if it is not one."""
    text = d.get(field)
    ok = isinstance(text, str) and text.startswith("0b") and len(text) == 2 + WIDTH and not set(text[2:]) - set("01")
    return int(text, 2) if ok else None


def _repeated(pairs: list[tuple[object, str]], what: str) -> Found:
    held = defaultdict(list)
    for value, name in pairs:
        held[value].append(name)
    for value, names in held.items():
        if len(names) > 1:
            yield names[0], f"{what} {value} is also that of {', '.join(names[1:])}"


@_check
def structure(defs, by) -> Found:
    for d in defs:
        for field in REQUIRED:
            if field not in d:
                yield _name(d), f"{field} is missing"
        if d.get("symmetric") is False and "reversed_arrow" not in d:
            yield _name(d), "reversed_arrow is missing"


@_check
def field_types(defs, by) -> Found:
    for d in defs:
        for field, kind in TYPES.items():
            if field in d and not isinstance(d[field], kind):
                yield _name(d), f"{field} is no {kind.__name__}"


@_check
def binary_format(defs, by) -> Found:
    for d in defs:
        for field in ("mask", "value"):
            if d.get(field) and _bits(d, field) is None:
                yield _name(d), f"{field} is not 0b and {WIDTH} bits"


@_check
def pattern_format(defs, by) -> Found:
    for d in defs:
        bands = str(d.get("pattern") or "").split("\t")
        if d.get("pattern") and (len(bands) != 3 or any(len(b) != 9 or set(b) - set("TF*") for b in bands)):
            yield _name(d), "pattern is not three bands of nine of T, F and *"


@_check
def pattern_of_test(defs, by) -> Found:
    for d in defs:
        mask, value = _bits(d, "mask"), _bits(d, "value")
        try:
            same = mask is None or value is None or not d.get("pattern") or test_of("".join(d["pattern"].split())) == (mask, value)
        except ValueError:
            same = True  # pattern_format says so
        if not same:
            yield _name(d), "pattern is not that of mask and value"


@_check
def value_in_mask(defs, by) -> Found:
    for d in defs:
        mask, value = _bits(d, "mask"), _bits(d, "value")
        if mask is not None and value is not None and value & ~mask:
            yield _name(d), "value has bits outside the mask"


@_check
def no_decimals(defs, by) -> Found:
    for d in defs:
        for field in DEPRECATED:
            if field in d:
                yield _name(d), f"{field} follows from the binary field and is not kept"


@_check
def test_parts(defs, by) -> Found:
    for d in defs:
        have = [f for f in ("pattern", "mask", "value") if d.get(f)]
        if len(have) not in (0, 3):
            yield _name(d), f"of pattern, mask and value only {', '.join(have)}"


@_check
def unique_patterns(defs, by) -> Found:
    yield from _repeated([(d["pattern"], _name(d)) for d in defs if d.get("pattern")], "pattern")


@_check
def unique_tests(defs, by) -> Found:
    yield from _repeated([((d["mask"], d.get("value")), _name(d)) for d in defs if d.get("mask")], "test")


@_check
def unique_types(defs, by) -> Found:
    yield from _repeated([(_name(d), _name(d)) for d in defs], "relation_type")


@_check
def disjoint_tests(defs, by) -> Found:
    tests = [(_name(d), (m, v)) for d in defs if (m := _bits(d, "mask")) and (v := _bits(d, "value")) is not None]
    for i, (a, p) in enumerate(tests):
        for b, q in tests[i + 1 :]:
            if (both := meet(p, q)) and p != q:
                yield a, f"{both[1]:027b} is also {b}"


@_check
def symmetric(defs, by) -> Found:
    for d in defs:
        if d.get("symmetric") and d.get("complementary_relation") != _name(d):
            yield _name(d), "is symmetric and not its own complement"


@_check
def complement(defs, by) -> Found:
    for d in defs:
        other = d.get("complementary_relation") or ""
        if not other:
            if not d.get("symmetric") and _bits(d, "mask"):
                yield _name(d), "has no complement"
        elif other not in by:
            yield _name(d), f"complement {other} is unknown"
        elif by[other].get("complementary_relation") != _name(d):
            yield _name(d), f"complement {other} has another one"


@_check
def transpose(defs, by) -> Found:
    for d in defs:
        other = by.get(d.get("complementary_relation") or "", {})
        for field in ("mask", "value"):
            a, b = _bits(d, field), _bits(other, field)
            if a is not None and b is not None and transpose_int(a) != b:
                yield _name(d), f"{field} is not the transpose of its complement's"


@_check
def symbol(defs, by) -> Found:
    for d in defs:
        if len(str(d.get("symbol") or "")) > 1:
            yield _name(d), "symbol is more than one character"


@_check
def unique_symbols(defs, by) -> Found:
    pairs = {(d["symbol"], frozenset((_name(d), d.get("complementary_relation") or _name(d)))) for d in defs if d.get("symbol")}
    yield from _repeated([(s, min(p)) for s, p in sorted(pairs, key=lambda x: (x[0], min(x[1])))], "symbol")


@_check
def complement_symbol(defs, by) -> Found:
    for d in defs:
        other = by.get(d.get("complementary_relation") or "")
        if not d.get("pattern") and d.get("reversed_arrow") and other and other.get("symbol") != d.get("symbol"):
            yield _name(d), "has no test of its own and another symbol than its complement"


@_check
def label(defs, by) -> Found:
    for d in defs:
        text = str(d.get("label") or "")
        if not text:
            yield _name(d), "label is empty"
        elif _name(d).lower() not in text.lower():
            yield _name(d), f"label {text} does not name it"
    yield from _repeated([(str(d["label"]).lower(), _name(d)) for d in defs if d.get("label")], "label")


@_check
def arrow(defs, by) -> Found:
    for d in defs:
        if d.get("symmetric") and "reversed_arrow" in d:
            yield _name(d), "is symmetric and has reversed_arrow"
        if d.get("symmetric") is False and "reversed_arrow" not in d:
            yield _name(d), "is not symmetric and has no reversed_arrow"


@_check
def one_arrow(defs, by) -> Found:
    for d in defs:
        other = by.get(d.get("complementary_relation") or "")
        if other and not d.get("symmetric") and bool(other.get("reversed_arrow")) == bool(d.get("reversed_arrow")) and _name(d) < _name(other):
            yield _name(d), "of a relation and its complement exactly one has the arrow reversed"


@_check
def description(defs, by) -> Found:
    yield from _repeated([(d["description"], _name(d)) for d in defs if d.get("description")], "description")


@_check
def implied(defs, by) -> Found:
    for d in defs:
        for other in _implied(d):
            if d.get("transitive"):
                yield _name(d), "is transitive and implies another"
            if other not in by:
                yield _name(d), f"implies {other}, which is unknown"
            elif not by[other].get("transitive"):
                yield _name(d), f"implies {other}, which is not transitive"


def _implied(d: dict) -> list[str]:
    value = d.get("implied_relation") or []
    return [value] if isinstance(value, str) else list(value)


@_check
def implied_circle(defs, by) -> Found:
    for d in defs:
        seen, todo = set(), _implied(d)
        while todo:
            x = todo.pop()
            if x == _name(d):
                yield _name(d), "implies itself"
                break
            if x in by and x not in seen:
                seen.add(x)
                todo += _implied(by[x])


@_check
def examples(defs, by) -> Found:
    for d in defs:
        for x in d["examples"] if isinstance(d.get("examples"), list) else []:
            if not isinstance(x, str) or not x.lower().endswith(".png"):
                yield _name(d), f"example {x} is no .png file"


def problems(text: str) -> list[tuple[str, str, str]]:
    """(check, relation_type, problem) of a definition file."""
    defs = json.loads(text)["Relationships"]
    by = {_name(d): d for d in reversed(defs)}
    return [(check, *found) for check, f in CHECKS.items() for found in f(defs, by)]


def report(spark: SparkSession, text: str) -> DataFrame:
    """A row for every check: (check, passed, n_problems, problems)."""
    found = problems(text)
    n = Counter(c for c, _, _ in found)
    rows = [(c, not n[c], n[c], [f"{name}: {what}" for k, name, what in found if k == c]) for c in CHECKS]
    return spark.createDataFrame(rows, "check string, passed boolean, n_problems int, problems array<string>")


def swapped_descriptions(texts: DataFrame) -> DataFrame:
    """(relation_type, complement) whose descriptions are not each other's with A and B
    exchanged. ``texts``: (relation_type, complement, description)."""
    other = texts.select(F.col("relation_type").alias("complement"), F.col("description").alias("_theirs"))
    both = texts.where("description is not null").join(other.where("_theirs is not null"), "complement")
    return both.where((F.col("relation_type") != F.col("complement")) & (swap_ab(F.col("description")) != F.col("_theirs"))).select("relation_type", "complement")
