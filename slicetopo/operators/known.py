"""What a Python worker has worked out before.

Structures of many sets are alike: copies, templates, and the slices of one structure, whose rings
repeat. The kernel's answers follow from the coordinates alone, so a worker keeps them by these,
under keys of the exact bytes, and asks the kernel for what is new only. A memory holds a bounded
number of entries and is emptied when it is full; results don't depend on what it holds. Memories are used from functions of modules: one in a closure would be sent along with each task."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Hashable

import numpy as np
import pyarrow as pa

from . import kernel as K


class Known:
    """Answers by key, at most ``most`` of them and those of one call."""

    def __init__(self, most: int):
        self.most, self.of = most, {}

    def many(self, keys: list[Hashable], answer: Callable[[list[int]], list]) -> list:
        """The answers of keys; ``answer`` gives those at the places of keys not met before."""
        own = self.of
        new = {k: i for i, k in enumerate(keys) if k not in own}
        if new:
            if len(own) + len(new) > self.most:
                own = {k: own[k] for k in keys if k in own}
            own.update(zip(new, answer(list(new.values())), strict=True))
            self.of = own
        return [own[k] for k in keys]

    def one(self, key: Hashable, answer: Callable[[], object]):
        return self.many([key], lambda _: [answer()])[0]


def region_key(a: K.Region) -> tuple:
    """What makes a region: its ops and the bytes of its rings."""
    return tuple((op, r.tobytes()) for op, r in a)


def packed_key(ops: str, n, xy) -> tuple:
    return ops, np.asarray(n, dtype=np.int32).tobytes(), np.asarray(xy, dtype=np.float64).tobytes()


def moved_pairs(pairs: list[tuple[K.Region, K.Region]]) -> tuple[list, list[tuple[K.Region, K.Region]]]:
    """Keys of pairs, and the pairs, moved to the origin where all coordinates are whole numbers
    of moderate size, so that the move is exact: pairs that differ by a move only are one. For
    answers that no move changes."""
    keys, out = [], []
    for a, b in pairs:
        rings = [r for x in (a, b) for _, r in x if len(r)]
        points = np.concatenate(rings) if rings else K.NO_RING
        if len(points) and (points == np.rint(points)).all() and np.abs(points).max() < 1e6:
            low = points.min(axis=0)
            if low.any():
                a, b = ([(op, r - low if len(r) else r) for op, r in x] for x in (a, b))
        keys.append((region_key(a), region_key(b)))
        out.append((a, b))
    return keys, out


#: Numbers of regions met, by their bytes.
_NAMES = Known(50_000)
_NUMBERS = itertools.count()


def pair_names(b: pa.RecordBatch):
    """A short key for the packed regions a and b of each row, by their exact bytes, and a function
    that gives the regions of a row."""

    def side(x: str) -> list[tuple]:
        parts = []
        for c, kind in (("n", np.int32), ("xy", np.float64)):
            own = b.column(f"{x}_{c}")
            at = own.offsets.to_numpy()
            flat = own.values.to_numpy(zero_copy_only=False).astype(kind, copy=False).tobytes()
            w = np.dtype(kind).itemsize
            parts.append([flat[i:j] for i, j in zip((at[:-1] * w).tolist(), (at[1:] * w).tolist(), strict=True)])
        return list(zip(b.column(f"{x}_ops").to_pylist(), *parts, strict=True))

    sides = side("a"), side("b")
    numbers = [_NAMES.many(s, lambda at: [next(_NUMBERS) for _ in at]) for s in sides]

    def region(i: int) -> tuple[K.Region, K.Region]:
        return tuple(K.unpack(ops, np.frombuffer(n, dtype=np.int32), np.frombuffer(xy)) for ops, n, xy in (s[i] for s in sides))

    return list(zip(*numbers, strict=True)), region
