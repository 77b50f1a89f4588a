"""Groups of rows as runs of sorted Arrow batches.

Structures, slices and tiles are many and small. A call for each of them costs more than what
they ask for, so rows are sorted by their group, and all groups of a batch are worked off in one
call: on columns, and by the exact bytes of each group's values."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import ship, spread
from .kernel import _within

TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
TYPES |= {f"array<{k}>": pa.list_(t) for k, t in list(TYPES.items())}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of columns as they are written here."""
    return pa.schema([(n, TYPES[t]) for n, t in (c.split(" ", 1) for c in schema.split(", "))])


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of a column of numbers begins, with the end of the last, and all numbers."""
    own = _whole(column)
    size = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64), own.flatten().to_numpy(zero_copy_only=False)


def spans(column, starts: np.ndarray) -> list[Hashable]:
    """What a column holds from each start to the next, exactly; equal spans are equal keys."""
    own = _whole(column)
    ends = np.append(starts[1:], len(own))
    cuts = list(zip(starts.tolist(), ends.tolist(), strict=True))
    if pa.types.is_list(own.type) and not pa.types.is_string(own.type.value_type):
        at, values = flat(own)
        sizes, w = np.diff(at).tobytes(), values.dtype.itemsize
        data, at = np.ascontiguousarray(values).tobytes(), (at * w).tolist()
        out = [(sizes[8 * i : 8 * j], data[at[i] : at[j]]) for i, j in cuts]
    elif pa.types.is_list(own.type) or pa.types.is_string(own.type):
        of = own.to_pylist()
        if pa.types.is_list(own.type):
            of = [None if x is None else tuple(x) for x in of]
        return [tuple(of[i:j]) for i, j in cuts]
    else:
        values = (pc.fill_null(own, 0) if not pa.types.is_boolean(own.type) else pc.fill_null(own, False)).to_numpy(zero_copy_only=False)
        w, data = values.dtype.itemsize, np.ascontiguousarray(values).tobytes()
        out = [data[w * i : w * j] for i, j in cuts]
    if own.null_count:
        gone = own.is_null().to_numpy(zero_copy_only=False).tobytes()
        out = [(x, gone[i:j]) for x, (i, j) in zip(out, cuts, strict=True)]
    return out


def names_of(table: pa.Table, starts: np.ndarray, columns) -> list[tuple]:
    """A key of each group's values in the columns."""
    return list(zip(*(spans(table[c], starts) for c in columns), strict=True))


def starts_of(table: pa.Table, keys) -> np.ndarray:
    """The first row of each run of rows with equal keys."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        c = _whole(table[k])
        a, b = c.slice(1), c.slice(0, max(n - 1, 0))
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def repeated(found: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
    """The rows of tables one after the other, and of which each row is; a table that stands many
    times is the same object."""
    place: dict[int, int] = {}
    which = np.array([place.setdefault(id(t), len(place)) for t in found], dtype=np.int64)
    own = list({id(t): t for t in found}.values())
    size = np.array([t.num_rows for t in own], dtype=np.int64)
    owner, k = _within(size[which])
    return pa.concat_tables(own).combine_chunks().take((np.cumsum(size) - size)[which][owner] + k), owner


def runs(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of entries whose counts add up to ``most``, or of one entry."""
    upto, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


#: Gives the rows of all groups of a table, by the first row of each.
Run = Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]


def in_groups(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], run: Run, schema: str) -> DataFrame:
    """``run`` over all groups of ``df``, dealt by keys over all cores; a group's rows are in
    ``order`` and in one call. The last group of a batch waits for the next batch."""
    ship(df.sparkSession)

    def walk(batches):
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([*rest, b])
                last = int(starts_of(t, keys)[-1])
                rest = t.slice(last).to_batches()
                if last:
                    yield from done(t.slice(0, last))
        if rest:
            yield from done(pa.Table.from_batches(rest))

    def done(t):
        t = t.combine_chunks()
        for out in run(t, starts_of(t, keys)):
            yield from out.cast(arrow_schema(schema)).combine_chunks().to_batches()

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)
