"""Relation definitions, the classifier built from them, and their validator.

A relation of two structures is 27 bits: three DE-9IM matrices (region, exterior,
hull), most significant bit first, each row-major II IB IE BI BB BE EI EB EE. A
definition holds where ``bits & mask == value``. The classifier is a generated CASE over
the definitions, so it stays inside whole-stage code generation; no join is needed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, label, symbol, symmetric, transitive, reversed arrow, complement,
#: implied, and the tests of region, exterior and hull (T set, F not set, * free).
TABLE = """
EQUAL       | is Equal to                      | =  | y | y | n | EQUAL       |           | T*F*T*F** | ********* | *********
CONTAINS    | Contains                         | ⊂  | n | y | n | WITHIN      |           | T*T*F*F** | ********* | *********
WITHIN      | is Within                        | ⊂  | n | y | y | CONTAINS    |           | T*F*F*T** | ********* | *********
PARTITIONED | is Partitioned by                | ⊕  | n | n | n | PARTITIONS  | CONTAINS  | T*T*T*F** | ********* | *********
PARTITIONS  | Partitions                       | ⊗  | n | n | y | PARTITIONED | WITHIN    | T*F*T*T** | ********* | *********
OVERLAPS    | Overlaps with                    | ∩  | y | n | n | OVERLAPS    |           | T*T***T** | ********* | *********
BORDERS     | Borders                          | \\| | y | n | n | BORDERS     |           | F***T**** | F*T***T** | *********
CONFINES    | Confines                         | ⊏  | n | n | n | CONFINED    | SURROUNDS | F*T*T*T** | T*T***F** | *********
CONFINED    | is Confined by                   | ⊏  | n | n | y | CONFINES    | ENCLOSED  | F*T*T*T** | T*F***T** | *********
SURROUNDS   | Surrounds                        | ○  | n | y | n | ENCLOSED    |           | F*T*F*T** | T*T***F** | *********
ENCLOSED    | is Enclosed by                   | ○  | n | y | y | SURROUNDS   |           | F*T*F*T** | T*F***T** | *********
SHELTERS    | Shelters                         | △  | n | y | n | SHELTERED   |           | F*T*F*T** | F******** | T*T***F**
SHELTERED   | is Sheltered by                  | △  | n | y | y | SHELTERS    |           | F*T*F*T** | F******** | T*F***T**
DISJOINT    | is Disjoint from                 | ∅  | y | n | n | DISJOINT    |           | F*T*F*T** | **T***T** | **T***T**
UNKNOWN     | has an Unknown relationship with | ?  | n | n | n |             |           | ********* | ********* | *********
"""

#: Display order of relations; UNKNOWN is 99.
RANK = ("EQUAL", "PARTITIONED", "PARTITIONS", "CONTAINS", "WITHIN", "CONFINES", "CONFINED", "SURROUNDS", "ENCLOSED", "BORDERS", "SHELTERS", "SHELTERED", "OVERLAPS", "DISJOINT")


@dataclass(frozen=True)
class Definition:
    name: str
    label: str
    symbol: str
    symmetric: bool
    transitive: bool
    reversed_arrow: bool
    complement: str
    implied: tuple[str, ...] = field(default=())
    mask: int = 0
    value: int = 0


def test_of(pattern: str) -> tuple[int, int]:
    """Mask and value of three bands of T, F and *."""
    flat = pattern.replace(" ", "")
    if len(flat) != 27 or set(flat) - set("TF*"):
        raise ValueError(f"not a pattern of three bands: {pattern}")
    bits = lambda ones: int("".join("1" if c in ones else "0" for c in flat), 2)
    return bits("TF"), bits("T")


def load(text: str = TABLE) -> list[Definition]:
    out = []
    for line in text.strip().splitlines():
        c = [x.strip() for x in line.replace("\\|", "\0").split("|")]
        out.append(Definition(c[0], c[1], c[2].replace("\0", "|"), c[3] == "y", c[4] == "y", c[5] == "y", c[6], tuple(c[7].split()), *test_of(" ".join(c[8:]))))
    return out


def from_json(text: str) -> list[Definition]:
    """Definitions of a JSON file: a list ``Relationships`` of objects with relation_type,
    label, symbol, symmetric, transitive, reversed_arrow, complementary_relation,
    implied_relation (a name or a list) and pattern, or mask and value as binary text."""
    out = []
    for x in json.loads(text)["Relationships"]:
        implied = x.get("implied_relation") or []
        mask, value = test_of("".join(x["pattern"].split())) if x.get("pattern") else (int(x["mask"], 2), int(x["value"], 2))
        out.append(Definition(x["relation_type"], x.get("label", ""), x.get("symbol", ""), bool(x.get("symmetric")), bool(x.get("transitive")), bool(x.get("reversed_arrow")), x.get("complementary_relation") or "", tuple([implied] if isinstance(implied, str) else implied), mask, value))
    return out


DEFINITIONS = load()
BY_NAME = {d.name: d for d in DEFINITIONS}


def transpose_int(bits: int) -> int:
    """Each 3 x 3 band transposed."""
    out = 0
    for band in range(3):
        for r in range(3):
            for c in range(3):
                if bits >> (26 - (band * 9 + r * 3 + c)) & 1:
                    out |= 1 << (26 - (band * 9 + c * 3 + r))
    return out


Cube = tuple[int, int]


def meet(p: Cube, q: Cube) -> Cube | None:
    """The patterns in both cubes, again a cube; None if there is none."""
    if (p[1] ^ q[1]) & p[0] & q[0]:
        return None
    return p[0] | q[0], p[1] | q[1]


def overlapping(definitions: list[Definition] = DEFINITIONS) -> list[tuple[str, str, int]]:
    """(name, name, a pattern that both take) of definitions that are not disjoint."""
    tested = [d for d in definitions if d.mask]
    return [(a.name, b.name, both[1]) for i, a in enumerate(tested) for b in tested[i + 1 :] if (both := meet((a.mask, a.value), (b.mask, b.value)))]


def classify(bits: Column, definitions: list[Definition] = DEFINITIONS) -> Column:
    """The name of the one definition that holds, UNKNOWN if none does or bits are null.
    Definitions of which two can hold at once are refused."""
    if definitions is not DEFINITIONS and (twice := overlapping(definitions)):
        raise ValueError("definitions overlap: " + ", ".join(f"{a} and {b} at {x:027b}" for a, b, x in twice))
    out = F.lit("UNKNOWN")
    for d in reversed([d for d in definitions if d.mask]):
        out = F.when(bits.bitwiseAND(F.lit(d.mask)) == F.lit(d.value), F.lit(d.name)).otherwise(out)
    return F.when(bits.isNull(), F.lit("UNKNOWN")).otherwise(out)


def lookup(name: Column, attribute: str, definitions: list[Definition] = DEFINITIONS) -> Column:
    """An attribute of the definition that ``name`` names, as a generated CASE."""
    value = lambda d: getattr(d, attribute)
    default = {bool: False, str: "", int: 0}[type(value(definitions[0]))]
    out = F.lit(default)
    for d in definitions:
        if value(d) != default:
            out = F.when(name == d.name, F.lit(value(d))).otherwise(out)
    return out


def rank(name: Column, compat: bool = False) -> Column:
    """Place in the display order; ``compat`` puts EQUAL last, at 99."""
    out = F.lit(99)
    for i, n in enumerate(RANK, 1):
        if not (compat and n == "EQUAL"):
            out = F.when(name == n, F.lit(i)).otherwise(out)
    return out


def relation_defs(spark: SparkSession, definitions: list[Definition] = DEFINITIONS) -> DataFrame:
    rows = [(d.name, d.label, d.symbol, d.symmetric, d.transitive, d.reversed_arrow, d.complement, list(d.implied), d.mask, d.value) for d in definitions]
    return spark.createDataFrame(rows, "relation_type string, label string, symbol string, symmetric boolean, transitive boolean, reversed_arrow boolean, complement string, implied array<string>, mask int, value int")


def validate(definitions: list[Definition] = DEFINITIONS) -> list[str]:
    """What is wrong with definitions; empty if nothing is."""
    wrong, names = [], [d.name for d in definitions]
    by = {d.name: d for d in definitions}
    for what, values in (("name", names), ("label", [d.label for d in definitions])):
        wrong += [f"{what} {x} is not unique" for x in sorted({v for v in values if values.count(v) > 1})]
    tests = [(d.mask, d.value) for d in definitions if d.mask]
    wrong += [f"test {t} is not unique" for t in sorted({t for t in tests if tests.count(t) > 1})]
    wrong += [f"{a} and {b} both hold at {x:027b}" for a, b, x in overlapping(definitions)]
    for d in definitions:
        if not d.name.isidentifier() or d.name != d.name.upper():
            wrong.append(f"{d.name}: a name is an upper-case identifier")
        if not 0 <= d.mask < 1 << 27 or d.value & ~d.mask:
            wrong.append(f"{d.name}: value outside mask")
        if d.name == "UNKNOWN":
            continue
        if d.complement not in by:
            wrong.append(f"{d.name}: complement {d.complement or 'missing'}")
            continue
        if by[d.complement].complement != d.name:
            wrong.append(f"{d.name}: complement is not mutual")
        if d.symmetric != (d.complement == d.name):
            wrong.append(f"{d.name}: symmetric means its own complement")
        other = by[d.complement]
        if (transpose_int(d.mask), transpose_int(d.value)) != (other.mask, other.value):
            wrong.append(f"{d.name}: test is not its complement's transpose")
        if d.transitive != other.transitive:
            wrong.append(f"{d.name}: transitive differs from its complement")
        for x in d.implied:
            if x not in by:
                wrong.append(f"{d.name}: implies unknown {x}")
            elif not by[x].transitive:
                wrong.append(f"{d.name}: implied {x} is not transitive")
    for d in definitions:
        seen, todo = set(), list(d.implied)
        while todo:
            x = todo.pop()
            if x == d.name:
                wrong.append(f"{d.name}: implies itself")
                break
            if x in by and x not in seen:
                seen.add(x)
                todo += by[x].implied
    return wrong
