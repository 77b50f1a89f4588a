"""Structure filters: name patterns and the ordered rule engine."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _valid(patterns: list[str]) -> list[str]:
    out = []
    for p in patterns:
        try:
            re.compile(p)
            out.append(p)
        except re.error:
            continue
    return out


def name_kept(name: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Exclusion goes before inclusion; names match exactly or by a search; patterns that
    are not valid are skipped; with an include list, what it does not name is left out."""

    def any_of(patterns: list[str]) -> Column:
        out = name.isin(patterns)
        for p in _valid(patterns):
            out = out | name.rlike(p)
        return out

    kept = F.lit(True) if not include else any_of(include)
    return kept & ~any_of(exclude) if exclude else kept


#: Fields that rules can look at, what rules do, and words for true and false.
FIELDS = ("Structure ID", "Structure Name", "DICOM Type", "Code", "Coding Scheme", "Code Meaning", "ROI Physical Property", "Density", "Contour Count", "Has Contours", "Generation Method", "Generation Description")
ACTIONS = ("exclude", "hide", "include", "display")
TRUE, FALSE = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")


@dataclass(frozen=True)
class Rule:
    """One rule: state changes (include, exclude, display, hide) where a field matches."""

    id: str
    action: str
    field: str
    match_type: str
    value: str | tuple[str, ...]
    case_sensitive: bool = False
    enabled: bool = True
    also: Rule | None = None
    description: str = ""

    @property
    def reason(self) -> str:
        shown = lambda r: f"{r.field} {r.match_type} {r.value if isinstance(r.value, str) else json.dumps(list(r.value), ensure_ascii=False)}"
        return shown(self) + (f"; with {shown(self.also)}" if self.also else "")


def truth(value: object, default: bool) -> bool:
    """A truth value of a file: a word for one, else the default."""
    if isinstance(value, bool):
        return value
    word = str("" if value is None else value).strip().lower()
    return word in TRUE or (word not in FALSE and default)


def from_json(text: str) -> dict:
    """Arguments of :func:`report` from a JSON file: ``rules`` in file order and what holds
    where no rule does. A rule has id (else rule_n), action (else exclude), field, match_type
    or match, value or pattern (a list for structure lists), case_sensitive, enabled,
    description and a companion ``with``. Without defaults of their own, structures are included
    and displayed. Entries that are no rules, and unknown actions, are left out."""
    raw = json.loads(text)
    raw = raw if isinstance(raw, dict) else {}
    words = lambda x: "" if x is None else str(x).strip()
    first = lambda x, *names: next((x[n] for n in names if n in x), None)

    def one(x: dict, k: int) -> Rule:
        value = first(x, "value", "pattern")
        also = one(x["with"], k) if isinstance(x.get("with"), dict) else None
        if x.get("with") is not None and also is None:
            also = Rule("", "", "", "", "")  # a companion that is no object never holds
        return Rule(
            words(x.get("id")) or f"rule_{k}", words(x.get("action", "exclude")).lower(), words(x.get("field")), words(first(x, "match_type", "match")).lower().replace("_", " "),
            tuple(words(v) for v in value if words(v)) if isinstance(value, list) else words(value), bool(x.get("case_sensitive", False)), truth(x.get("enabled", True), True), also, words(x.get("description")),
        )

    found = raw.get("rules", [])
    rules = [one(x, k) for k, x in enumerate(found if isinstance(found, list) else [], 1) if isinstance(x, dict)]
    return {"rules": [r for r in rules if r.action in ACTIONS], "default": "include" if truth(first(raw, "include by default", "include_by_default"), True) else "exclude", "displayed": truth(first(raw, "display by default", "display_by_default"), True)}


def matches(rule: Rule, columns: list[str]) -> Column:
    """Regular expression, exact, prefix, suffix, or a case-sensitive structure list, which
    counts for the field Structure ID only. A field that the rows lack never matches."""
    if rule.field not in columns:
        return F.lit(False)
    x = F.coalesce(F.col(f"`{rule.field}`").cast("string"), F.lit(""))
    if rule.match_type == "structure list":
        hit = x.isin(*rule.value) if rule.field == "Structure ID" and not isinstance(rule.value, str) else F.lit(False)
    elif not rule.value or not rule.match_type or not isinstance(rule.value, str):
        hit = F.lit(False)
    elif rule.match_type == "regex":
        hit = x.rlike(("" if rule.case_sensitive else "(?i)") + rule.value) if _valid([rule.value]) else F.lit(False)
    else:
        v = F.lit(rule.value if rule.case_sensitive else rule.value.lower())
        y = x if rule.case_sensitive else F.lower(x)
        hit = {"exact": y == v, "prefix": y.startswith(v), "suffix": y.endswith(v)}.get(rule.match_type, F.lit(False))
    return hit & matches(rule.also, columns) if rule.also and rule.match_type != "structure list" else hit


_ENTRY = ("id", "action", "description", "field", "match_type", "value", "reason")


def _entry(rule: Rule) -> Column:
    """What a report says of a rule that matched."""
    value = rule.value if isinstance(rule.value, str) else json.dumps(list(rule.value), ensure_ascii=False)
    said = (rule.id, rule.action, rule.description or rule.id, rule.field, rule.match_type, value, rule.reason)
    return F.struct(*[F.lit(x).alias(n) for n, x in zip(_ENTRY, said, strict=True)])


def report(rows: DataFrame, rules: list[Rule], default: str = "include", displayed: bool = True) -> DataFrame:
    """``rows`` with SelectedByDefault, DisplayedByDefault, IsFiltered, IsHidden, MatchedRules
    (an entry for each rule that holds, in order), FinalMatch (the last of these) and
    FilterReason (its reason, empty without one). The last matching rule of a state wins."""
    used = [r for r in rules if r.enabled]
    selected, displayed = F.lit(default == "include"), F.lit(displayed)
    for r in used:
        hit = matches(r, rows.columns)
        if r.action in ("include", "exclude"):
            selected = F.when(hit, F.lit(r.action == "include")).otherwise(selected)
        elif r.action in ("display", "hide"):
            displayed = F.when(hit, F.lit(r.action == "display")).otherwise(displayed)
    none = F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in _ENTRY) + ">>")
    found = F.array_compact(F.array(*[F.when(matches(r, rows.columns), _entry(r)) for r in used])) if used else none
    out = rows.withColumns({"SelectedByDefault": selected, "DisplayedByDefault": displayed, "MatchedRules": found})
    final = F.try_element_at("MatchedRules", F.lit(-1))
    return out.withColumns({"IsFiltered": ~F.col("SelectedByDefault"), "IsHidden": ~F.col("DisplayedByDefault"), "FinalMatch": final, "FilterReason": F.coalesce(final["reason"], F.lit(""))})


def preview(reported: DataFrame) -> DataFrame:
    """Counts of matched, selected and hidden rows."""
    return reported.agg(F.count_if(F.size("MatchedRules") > 0).alias("matched"), F.count_if("SelectedByDefault").alias("selected"), F.count_if("IsHidden").alias("hidden"))


def without_excluded(rows: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    return rows.join(reported.where("IsFiltered").select(key), key, "left_anti")
