"""Which relations follow from others: by transitivity, by implication, by equality.

A set's relations are a small graph; sets are spread over tasks, and a set's graph is
walked in its task. Directed edges go from larger to smaller structures, so the graph
without equal structures has no cycles, and path counts and longest paths come from
dynamic programming in place of enumerating paths.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.definitions import BY_NAME, DEFINITIONS
from ..session import ship

OUT = "set_id string, roi_a int, roi_b int, relation string, is_logical boolean, intermediates array<int>"


def _walks(edges: dict[int, set[int]]):
    """Functions for the number of paths between two nodes, and the longest path, the
    smallest in order among equals. Nodes on a walk are not entered again."""

    @lru_cache(maxsize=None)
    def count(a: int, b: int) -> int:
        return 1 if a == b else sum(count(x, b) for x in edges.get(a, ()))

    @lru_cache(maxsize=None)
    def longest(a: int, b: int) -> tuple[int, ...] | None:
        if a == b:
            return (a,)
        found = [(a, *p) for x in sorted(edges.get(a, ())) if (p := longest(x, b))]
        return min(found, key=lambda p: (-len(p), p)) if found else None

    return count, longest


def _through(edges: dict[int, set[int]], own: set[tuple[int, int]]):
    """A function for the longest path between two nodes with one edge at least of ``own``."""

    @lru_cache(maxsize=None)
    def longest(a: int, b: int, met: bool = False) -> tuple[int, ...] | None:
        if a == b:
            return (a,) if met else None
        found = [(a, *p) for x in sorted(edges.get(a, ())) if (p := longest(x, b, met or (a, x) in own))]
        return min(found, key=lambda p: (-len(p), p)) if found else None

    return longest


def _acyclic(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that do not close a cycle, in order; only odd input has such."""
    out, after = [], defaultdict(set)

    def reaches(a, b):
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += after[x]
        return False

    for a, b in pairs:
        if not reaches(b, a):
            after[a].add(b)
            out.append((a, b))
    return out


def flag_set(rows: list[tuple[int, int, str]], order: list[int]) -> dict[tuple[int, int], tuple[bool, list[int]]]:
    """(is_logical, intermediates) of each edge; ``order``: structures, largest first."""
    flags = {(a, b): (False, []) for a, b, _ in rows}
    kind = {(a, b): t for a, b, t in rows}
    place = {r: i for i, r in enumerate(order)}
    # Transitive types share a graph; an edge with another way round is logical.
    direct = [(a, b) for a, b, t in rows if BY_NAME[t].transitive and t != "EQUAL"]
    edges = defaultdict(set)
    for a, b in _acyclic(direct):
        edges[a].add(b)
    count, longest = _walks(edges)
    for a, b, t in rows:
        if t != "EQUAL" and count(a, b) > 1 and (p := longest(a, b)) and len(p) > 2:
            flags[a, b] = (True, list(p[1:-1]))
    # A type that others imply: paths may mix it with those, one edge at least its own.
    for target in {x for d in DEFINITIONS for x in d.implied}:
        own = {(a, b) for a, b, t in rows if t == target}
        implying = {(a, b) for a, b, t in rows if target in BY_NAME[t].implied}
        if not implying:
            continue
        edges = defaultdict(set)
        for a, b in _acyclic(sorted(own | implying)):
            edges[a].add(b)
        longest = _through(edges, own) if target in ("CONTAINS", "WITHIN") else _walks(edges)[1]
        for a, b in own:
            p = longest(a, b)
            if p and len(p) > 2 and not flags[a, b][0]:
                flags[a, b] = (True, list(p[1:-1]))
    # Equal structures: the largest stands for the others.
    root = {r: r for r in order}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b, t in rows:
        if t == "EQUAL":
            p, q = sorted((find(a), find(b)), key=place.get)
            root[q] = p
    for (a, b), t in kind.items():
        ca, cb = find(a), find(b)
        if t == "EQUAL":
            if ca not in (a, b):
                flags[a, b] = (True, [ca])
        elif (ca, cb) != (a, b):
            top = (ca, cb) if (ca, cb) in kind else (cb, ca)
            if kind.get(top) == t:
                via = [c for c, x in ((ca, a), (cb, b)) if c != x]
                flags[a, b] = (True, [*via, *[x for x in flags[a, b][1] if x not in via]])
    for (a, b), t in kind.items():
        # What only equal peers suggested does not make the canonical edge logical.
        if t != "EQUAL" and find(a) == a and find(b) == b and flags[a, b][0]:
            rest = [x for x in flags[a, b][1] if find(x) not in (a, b)]
            flags[a, b] = (bool(rest), rest)
    return flags


def _flag(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(int(a), int(b), t) for a, b, t in zip(pdf["roi_a"], pdf["roi_b"], pdf["relation"], strict=True)]
    before = defaultdict(int)
    for a, b, _ in rows:
        before[a] += 0
        before[b] += 1
    order = sorted(before, key=lambda r: (before[r], r))
    got = flag_set(rows, order)
    return pd.DataFrame([(pdf["set_id"].iloc[0], a, b, t, *got[a, b]) for a, b, t in rows], columns=["set_id", "roi_a", "roi_b", "relation", "is_logical", "intermediates"])


def flags(relations: DataFrame) -> DataFrame:
    """Relations with is_logical and intermediates, set by set."""
    ship(relations.sparkSession)
    return relations.select(relations.set_id.cast("string").alias("set_id"), relations.roi_a.cast("int").alias("roi_a"), relations.roi_b.cast("int").alias("roi_b"), "relation").groupBy("set_id").applyInPandas(_flag, OUT)
