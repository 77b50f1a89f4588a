"""Planar geometry on regions with holes, in numpy.

A region is an ordered list of (op, ring): `+` adds a ring's inside, `-` takes it away,
`&` keeps what is inside; `|`, without a ring, ends a part: a region is the union of its
parts. All segments of the rings of two regions are cut where they
meet; what lies left and right of each piece then decides every question whose answer
is a set of dimension one or more: the cells of a DE-9IM matrix, areas of any
combination, lengths along rays. Contacts in single points count as no contact.
"""

from __future__ import annotations

import math

import numpy as np

SNAP = 1e-9
II, IB, IE, BI, BB, BE, EI, EB, EE = (1 << (8 - i) for i in range(9))

Region = list  # of (op, ring)
NO_RING = np.zeros((0, 2))


def pack(a: Region) -> tuple[str, list[int], list[float]]:
    """A region as its ops, the numbers of points, and all coordinates in a row."""
    flat = [r for _, r in a]
    return "".join(op for op, _ in a), [len(r) for r in flat], np.concatenate(flat).ravel().tolist() if flat else []


def unpack(ops: str, sizes, xy) -> Region:
    points = np.asarray(xy, dtype=float).reshape(-1, 2)
    ends = np.cumsum(np.asarray(sizes, dtype=int))
    return [(op, points[e - n : e]) for op, n, e in zip(ops, sizes, ends, strict=True)]


def bounds(a: Region) -> np.ndarray | None:
    """Least and largest x and y of all rings that add; None without any."""
    points = [r for op, r in a if op == "+" and len(r)]
    if not points:
        return None
    p = np.concatenate(points)
    return np.concatenate([p.min(axis=0), p.max(axis=0)])


def apart(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two bounds have a gap between them."""
    return bool((p[:2] > q[2:] + 1e-7).any() or (q[:2] > p[2:] + 1e-7).any())


def ring_of(points) -> np.ndarray:
    """A ring without repeated neighbours or closing point."""
    p = np.asarray(points, dtype=float).reshape(-1, 2)
    if len(p) > 1:
        keep = np.any(np.abs(p - np.roll(p, 1, axis=0)) > SNAP, axis=1)
        p = p[keep] if keep.any() else p[:1]
    return p


def ring_area(p: np.ndarray) -> float:
    """Signed: positive when counter-clockwise."""
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def centroid(p: np.ndarray) -> np.ndarray:
    q = np.roll(p, -1, axis=0)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    s = c.sum()
    return ((p + q) * c[:, None]).sum(axis=0) / (3 * s) if abs(s) > SNAP else p.mean(axis=0)


def is_simple(p: np.ndarray) -> bool:
    """Three points at least, some area, and no two edges that cross."""
    if len(p) < 3 or abs(ring_area(p)) < SNAP:
        return False
    a, b = p, np.roll(p, -1, axis=0)
    n = len(p)
    d = lambda o, u, v: (u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0])
    A, B, C, E = a[:, None], b[:, None], a[None], b[None]
    cross = (d(A, B, C) * d(A, B, E) < -SNAP) & (d(C, E, A) * d(C, E, B) < -SNAP)
    return not np.any(np.triu(cross, 1)[: n, : n])


def inside_ring(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of each point, none of them on the ring."""
    x, y = points[:, 0][:, None], points[:, 1][:, None]
    p, q = ring, np.roll(ring, -1, axis=0)
    spans = (p[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
    return (np.where(spans, x < at, False).sum(axis=1) % 2).astype(bool)


def inside(points: np.ndarray, region: Region) -> np.ndarray:
    done = np.zeros(len(points), dtype=bool)
    out = done.copy()
    for op, ring in region:
        if op == "|":
            done |= out
            out = np.zeros(len(points), dtype=bool)
            continue
        here = inside_ring(points, ring)
        out = out | here if op == "+" else out & ~here if op == "-" else out & here
    return done | out


def union(a: Region, b: Region) -> Region:
    return [*a, ("|", NO_RING), *b] if a and b else a or b


def segments(*regions: Region) -> np.ndarray:
    rings = [r for region in regions for _, r in region if len(r) >= 2]
    if not rings:
        return np.zeros((0, 4))
    return np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings])


def noded(seg: np.ndarray) -> np.ndarray:
    """Pieces of segments, cut wherever two of them meet, without repetition."""
    if not len(seg):
        return seg
    p, r = seg[:, :2], seg[:, 2:] - seg[:, :2]
    size = np.hypot(r[:, 0], r[:, 1])
    seg, p, r, size = seg[size > SNAP], p[size > SNAP], r[size > SNAP], size[size > SNAP]
    lo, hi = np.minimum(seg[:, :2], seg[:, 2:]) - 1e-7, np.maximum(seg[:, :2], seg[:, 2:]) + 1e-7
    near = (lo[:, None, 0] <= hi[None, :, 0]) & (lo[None, :, 0] <= hi[:, None, 0]) & (lo[:, None, 1] <= hi[None, :, 1]) & (lo[None, :, 1] <= hi[:, None, 1])
    i, j = np.nonzero(near)
    i, j = i[i != j], j[i != j]
    cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    d = p[j] - p[i]
    den = cross(r[i], r[j])
    flat = np.abs(den) <= 1e-12 * size[i] * size[j]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(d, r[j]) / den, cross(d, r[i]) / den
    slack = 1e-9
    ok = ~flat & (u >= -slack / size[j]) & (u <= 1 + slack / size[j]) & (t > 0) & (t < 1)
    own, at = [i[ok]], [t[ok]]
    # On one line: the other's ends cut this one.
    line = flat & (np.abs(cross(d, r[i])) <= 1e-9 * size[i] * np.maximum(1, np.hypot(d[:, 0], d[:, 1])))
    for k in (0, 2):
        e = seg[j[line]][:, k : k + 2] - p[i[line]]
        tt = (e * r[i[line]]).sum(axis=1) / size[i[line]] ** 2
        good = (tt > 0) & (tt < 1)
        own.append(i[line][good])
        at.append(tt[good])
    own, at = np.concatenate([*own, np.arange(len(seg)), np.arange(len(seg))]), np.concatenate([*at, np.zeros(len(seg)), np.ones(len(seg))])
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    same = own[1:] == own[:-1]
    a, b, k = at[:-1][same], at[1:][same], own[:-1][same]
    keep = (b - a) * size[k] > 1e-8
    a, b, k = a[keep], b[keep], k[keep]
    pieces = np.hstack([p[k] + r[k] * a[:, None], p[k] + r[k] * b[:, None]])
    flip = (pieces[:, 0] > pieces[:, 2] + 1e-10) | ((np.abs(pieces[:, 0] - pieces[:, 2]) <= 1e-10) & (pieces[:, 1] > pieces[:, 3]))
    pieces[flip] = pieces[flip][:, [2, 3, 0, 1]]
    _, first = np.unique(np.round(pieces, 7) + 0.0, axis=0, return_index=True)
    return pieces[np.sort(first)]


def sides(pieces: np.ndarray, region: Region) -> tuple[np.ndarray, np.ndarray]:
    """Whether the region lies left and right of each piece."""
    d = pieces[:, 2:] - pieces[:, :2]
    size = np.hypot(d[:, 0], d[:, 1])
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2 + d * 0.0137
    step = np.minimum(1e-6, size * 1e-3) / size
    off = np.stack([-d[:, 1], d[:, 0]], axis=1) * step[:, None]
    return inside(mid + off, region), inside(mid - off, region)


def _apart(p: np.ndarray, q: np.ndarray) -> bool:
    lo_p, hi_p = p.reshape(-1, 2).min(axis=0), p.reshape(-1, 2).max(axis=0)
    lo_q, hi_q = q.reshape(-1, 2).min(axis=0), q.reshape(-1, 2).max(axis=0)
    return bool((lo_p > hi_q + 1e-7).any() or (lo_q > hi_p + 1e-7).any())


def is_convex(p: np.ndarray) -> bool:
    d = np.roll(p, -1, axis=0) - p
    e = np.roll(d, -1, axis=0)
    c = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    return len(p) >= 3 and bool((c >= 0).all() or (c <= 0).all()) and is_simple(p)


def relate(a: Region, b: Region) -> int:
    """The nine bits of two regions."""
    seg_a, seg_b = segments(a), segments(b)
    if len(seg_a) and len(seg_b) and _apart(seg_a, seg_b):
        # Boxes that don't meet: all that matters is that each is not empty.
        return EE + (IE | BE if len(boundary(a)) else 0) + (EI | EB if len(boundary(b)) else 0)
    pieces = noded(np.concatenate([seg_a, seg_b]))
    if not len(pieces):
        return EE
    al, ar = sides(pieces, a)
    bl, br = sides(pieces, b)
    on_a, on_b = al != ar, bl != br
    cells = ((II, (al & bl) | (ar & br)), (IE, (al & ~bl) | (ar & ~br)), (EI, (~al & bl) | (~ar & br)), (BB, on_a & on_b), (IB, on_b & al & ar), (BI, on_a & bl & br), (EB, on_b & ~al & ~ar), (BE, on_a & ~bl & ~br))
    return EE + sum(bit for bit, hit in cells if hit.any())


#: Pairs of segments that :func:`relate_many` looks at in one go.
AT_ONCE = 1_000_000


def _in_runs(pairs: list[tuple[Region, Region]], each) -> np.ndarray:
    """``each`` over runs of pairs of a bounded number of segments."""
    size = np.array([sum(len(r) for _, r in a) + sum(len(r) for _, r in b) for a, b in pairs], dtype=np.int64) ** 2
    out, lo, upto = [np.zeros(0)], 0, np.cumsum(size)
    while lo < len(pairs):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        out.append(each(pairs[lo:hi]))
        lo = hi
    return np.concatenate(out)


def relate_many(pairs: list[tuple[Region, Region]]) -> np.ndarray:
    """The nine bits of many pairs of regions: what :func:`relate` does, for all in the same
    arrays, with segments of different pairs kept apart."""
    return _in_runs(pairs, _relate_some).astype(np.int64)


def relate27_many(pairs: list[tuple[Region, Region]]) -> np.ndarray:
    """What :func:`relate27` does, for many pairs: the bands of what is filled and convex
    already are the same."""
    todo, plain = [], []
    for a, b in pairs:
        plain.append(all(len(x) == 1 and is_convex(x[0][1]) for x in (a, b)))
        todo += [(a, b)] if plain[-1] else [(a, b), (solid(a), solid(b)), (hull(a), hull(b))]
    nine = iter(relate_many(todo).tolist())
    return np.array([next(nine) * ((1 << 18) + (1 << 9) + 1) if one else next(nine) << 18 | next(nine) << 9 | next(nine) for one in plain], dtype=np.int64)


def common_areas(pairs: list[tuple[Region, Region]]) -> np.ndarray:
    """The area that both regions of each pair have."""

    def some(run: list[tuple[Region, Region]]) -> np.ndarray:
        pieces, pair, (al, ar, bl, br) = _sides_of(run)
        c = (pieces[:, 0] * pieces[:, 3] - pieces[:, 2] * pieces[:, 1]) / 2
        return np.bincount(pair, weights=c * ((al & bl).astype(int) - (ar & br).astype(int)), minlength=len(run))

    return _in_runs(pairs, some)


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: the run of each entry and its place in the run."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Rings:
    """All rings of many pairs, side by side: their segments, owners and ops."""

    def __init__(self, pairs: list[tuple[Region, Region]]):
        rings, owner, side, ops, place = [], [], [], [], []
        for k, pair in enumerate(pairs):
            for s, region in enumerate(pair):
                for t, (op, r) in enumerate(region):
                    rings.append(r)
                    owner.append(k)
                    side.append(s)
                    ops.append("+-&|".index(op) + 1)
                    place.append(t)
        size = np.array([len(r) for r in rings], dtype=np.int64)
        self.n, self.most = len(pairs), max(place, default=-1) + 1
        # Ops by side, pair and place; 0 for none.
        self.ops = np.zeros((2, self.n, self.most), dtype=np.int8)
        self.ops[side, owner, place] = ops
        points = np.concatenate([*rings, NO_RING])
        ring, at = _within(size)
        follow = np.arange(len(points)) + 1
        last = at == size[ring] - 1
        follow[last] -= size[ring][last]
        self.seg = np.hstack([points, points[follow]])
        self.pair, self.side, self.place = (np.array(x, dtype=np.int64)[ring] for x in (owner, side, place))

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the segments of each pair, cut where two of a pair meet, and their pairs."""
        r = self.seg[:, 2:] - self.seg[:, :2]
        size = np.hypot(r[:, 0], r[:, 1])
        use = size > SNAP
        seg, r, size, pair = self.seg[use], r[use], size[use], self.pair[use]
        p = seg[:, :2]
        lo, hi = np.minimum(p, seg[:, 2:]) - 1e-7, np.maximum(p, seg[:, 2:]) + 1e-7
        count = np.bincount(pair, minlength=self.n)
        begin = np.cumsum(count) - count
        i, k = _within(count[pair])
        j = begin[pair[i]] + k
        near = (i != j) & (lo[i, 0] <= hi[j, 0]) & (lo[j, 0] <= hi[i, 0]) & (lo[i, 1] <= hi[j, 1]) & (lo[j, 1] <= hi[i, 1])
        i, j = i[near], j[near]
        cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
        d, den = p[j] - p[i], cross(r[i], r[j])
        flat = np.abs(den) <= 1e-12 * size[i] * size[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross(d, r[j]) / den, cross(d, r[i]) / den
        slack = 1e-9 / size[j]
        ok = ~flat & (u >= -slack) & (u <= 1 + slack) & (t > 0) & (t < 1)
        own, at = [i[ok]], [t[ok]]
        line = flat & (np.abs(cross(d, r[i])) <= 1e-9 * size[i] * np.maximum(1, np.hypot(d[:, 0], d[:, 1])))
        for c in (0, 2):
            e = seg[j[line]][:, c : c + 2] - p[i[line]]
            tt = (e * r[i[line]]).sum(axis=1) / size[i[line]] ** 2
            good = (tt > 0) & (tt < 1)
            own.append(i[line][good])
            at.append(tt[good])
        every = np.arange(len(seg))
        own, at = np.concatenate([*own, every, every]), np.concatenate([*at, np.zeros(len(seg)), np.ones(len(seg))])
        order = np.lexsort((at, own))
        own, at = own[order], at[order]
        same = own[1:] == own[:-1]
        a, b, k = at[:-1][same], at[1:][same], own[:-1][same]
        keep = (b - a) * size[k] > 1e-8
        a, b, k = a[keep], b[keep], k[keep]
        out = np.hstack([p[k] + r[k] * a[:, None], p[k] + r[k] * b[:, None]])
        flip = (out[:, 0] > out[:, 2] + 1e-10) | ((np.abs(out[:, 0] - out[:, 2]) <= 1e-10) & (out[:, 1] > out[:, 3]))
        out[flip] = out[flip][:, [2, 3, 0, 1]]
        whole = np.round(out * 1e7).astype(np.int64)
        order = np.lexsort((*whole.T, pair[k]))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (whole[order][1:] != whole[order][:-1]).any(axis=1) | (pair[k][order][1:] != pair[k][order][:-1])
        return out[order[first]], pair[k][order[first]]

    def inside(self, points: np.ndarray, pair: np.ndarray, side: int) -> np.ndarray:
        """Whether points lie in the region of a side of their pair."""
        mine = np.flatnonzero(self.side == side)
        count = np.bincount(self.pair[mine], minlength=self.n)
        begin = np.cumsum(count) - count
        at, k = _within(count[pair])
        edge = mine[begin[pair[at]] + k]
        x0, y0, x1, y1 = self.seg[edge].T
        px, py = points[at].T
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((y0 > py) != (y1 > py)) & (px < x0 + (py - y0) * (x1 - x0) / (y1 - y0))
        odd = np.bincount(at[hit] * self.most + self.place[edge[hit]], minlength=len(points) * self.most).reshape(-1, self.most) % 2 == 1
        done, out = np.zeros(len(points), dtype=bool), np.zeros(len(points), dtype=bool)
        for t in range(self.most):
            op, here = self.ops[side, pair, t], odd[:, t]
            done |= out & (op == 4)
            out = np.where(op == 1, out | here, np.where(op == 2, out & ~here, np.where(op == 3, out & here, np.where(op == 4, False, out))))
        return done | out


def _sides_of(pairs: list[tuple[Region, Region]]):
    """Pieces of all pairs, their pairs, and whether each region lies left and right of them."""
    rings = _Rings(pairs)
    none = np.zeros(0, dtype=bool)
    if not rings.most:
        return np.zeros((0, 4)), np.zeros(0, dtype=np.int64), (none,) * 4
    pieces, pair = rings.pieces()
    d = pieces[:, 2:] - pieces[:, :2]
    size = np.hypot(d[:, 0], d[:, 1])
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2 + d * 0.0137
    off = np.stack([-d[:, 1], d[:, 0]], axis=1) * (np.minimum(1e-6, size * 1e-3) / size)[:, None]
    both = np.concatenate([mid + off, mid - off])
    return pieces, pair, tuple(x for s in (0, 1) for x in np.split(rings.inside(both, np.tile(pair, 2), s), 2))


def _relate_some(pairs: list[tuple[Region, Region]]) -> np.ndarray:
    _, pair, (al, ar, bl, br) = _sides_of(pairs)
    on_a, on_b = al != ar, bl != br
    cells = ((II, (al & bl) | (ar & br)), (IE, (al & ~bl) | (ar & ~br)), (EI, (~al & bl) | (~ar & br)), (BB, on_a & on_b), (IB, on_b & al & ar), (BI, on_a & bl & br), (EB, on_b & ~al & ~ar), (BE, on_a & ~bl & ~br))
    out = np.full(len(pairs), EE)
    for bit, hit in cells:
        out += bit * (np.bincount(pair[hit], minlength=len(pairs)) > 0)
    return out


def combined_area(regions: list[Region], keep) -> float:
    """Area where ``keep`` of the regions' membership holds."""
    pieces = noded(segments(*regions))
    if not len(pieces):
        return 0.0
    both = [sides(pieces, r) for r in regions]
    left, right = keep(*[x for x, _ in both]), keep(*[x for _, x in both])
    c = (pieces[:, 0] * pieces[:, 3] - pieces[:, 2] * pieces[:, 1]) / 2
    return float((c * (left.astype(int) - right.astype(int))).sum())


def area(a: Region) -> float:
    return combined_area([a], lambda x: x)


def region_centroid(a: Region) -> np.ndarray:
    """The centroid of all of a region's area, without its holes; NaN if it has none."""
    pieces = noded(segments(a))
    if not len(pieces):
        return np.full(2, math.nan)
    left, right = sides(pieces, a)
    c = (pieces[:, 0] * pieces[:, 3] - pieces[:, 2] * pieces[:, 1]) * (left.astype(int) - right.astype(int))
    return ((pieces[:, :2] + pieces[:, 2:]) * c[:, None]).sum(axis=0) / (3 * c.sum()) if abs(c.sum()) > SNAP else np.full(2, math.nan)


def boundary(a: Region) -> np.ndarray:
    """The pieces that bound a region."""
    pieces = noded(segments(a))
    if not len(pieces):
        return pieces
    left, right = sides(pieces, a)
    return pieces[left != right]


def convex_hull(points: np.ndarray) -> np.ndarray:
    p = np.unique(np.round(points, 12), axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 1e-12:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(list(p)) + half(list(p[::-1])))


def hull(a: Region) -> Region:
    b = boundary(a)
    return [("+", convex_hull(b.reshape(-1, 2)))] if len(b) else []


def solid(a: Region) -> Region:
    """Holes filled: the outer rings, part by part."""
    return [(op, r) for op, r in a if op != "-"]


def _point_segments(points: np.ndarray, seg: np.ndarray) -> np.ndarray:
    p, r = seg[:, :2], seg[:, 2:] - seg[:, :2]
    d = points[:, None] - p[None]
    t = np.clip((d * r[None]).sum(axis=2) / np.maximum((r * r).sum(axis=1), 1e-300)[None], 0, 1)
    return np.hypot(*np.moveaxis(d - r[None] * t[:, :, None], 2, 0))


def gap(p: np.ndarray, q: np.ndarray) -> float:
    """Least distance of two boundaries' pieces that don't meet; NaN if one has none."""
    if not len(p) or not len(q):
        return math.nan
    return float(min(_point_segments(p.reshape(-1, 2), q).min(), _point_segments(q.reshape(-1, 2), p).min()))


def distance(a: Region, b: Region) -> float:
    """Least distance; 0 where insides or boundaries meet, NaN if one is empty."""
    d = gap(boundary(a), boundary(b))
    return 0.0 if not math.isnan(d) and relate(a, b) & (II | BB) else d


def boundary_distance(a: Region, b: Region) -> float:
    d = gap(boundary(a), boundary(b))
    return 0.0 if not math.isnan(d) and relate(a, b) & BB else d


def outlines(a: Region, b: Region) -> tuple[float, float, float, float, float]:
    """Lengths of the boundary that both have, and of the outlines and of the holes of each."""
    pieces = noded(segments(a, b))
    if not len(pieces):
        return 0.0, 0.0, 0.0, 0.0, 0.0
    size = np.hypot(pieces[:, 2] - pieces[:, 0], pieces[:, 3] - pieces[:, 1])
    on, outline = ([np.logical_xor(*sides(pieces, r)) for r in rs] for rs in ((a, b), (solid(a), solid(b))))
    own = [float(size[x & keep].sum()) for x, y in zip(on, outline, strict=True) for keep in (y, ~y)]
    return float(size[on[0] & on[1]].sum()), *own


def common_boundary(a: Region, b: Region) -> tuple[float, float, float]:
    """Lengths of the boundary that both have, and of each one's."""
    both, out_a, hole_a, out_b, hole_b = outlines(a, b)
    return both, out_a + hole_a, out_b + hole_b


def farthest(p: np.ndarray, q: np.ndarray) -> float:
    """Discrete: the farthest end of one boundary's pieces from the ends of the other's."""
    p, q = p.reshape(-1, 2), q.reshape(-1, 2)
    if not len(p) or not len(q):
        return math.nan
    d = np.hypot(*np.moveaxis(p[:, None] - q[None], 2, 0))
    return float(max(d.min(axis=1).max(), d.min(axis=0).max()))


def hausdorff(a: Region, b: Region) -> float:
    return farthest(boundary(a), boundary(b))


def ray_length(a: Region, b: Region, start: np.ndarray, towards: np.ndarray) -> float:
    """Length, along a segment, of what is in a and not in b."""
    seg = np.concatenate([[[*start, *towards]], segments(a, b)])
    pieces = noded(seg)
    d = towards - start
    size = np.hypot(*d)
    e0, e1 = pieces[:, :2] - start, pieces[:, 2:] - start
    on = (np.abs(e0[:, 0] * d[1] - e0[:, 1] * d[0]) < 1e-7 * size) & (np.abs(e1[:, 0] * d[1] - e1[:, 1] * d[0]) < 1e-7 * size) & ((e0 @ d) > -1e-7) & ((e0 @ d) < size * size + 1e-7)
    pieces = pieces[on]
    al, ar = sides(pieces, a)
    bl, br = sides(pieces, b)
    hit = al & ar & ~bl & ~br
    return float(np.hypot(*(pieces[hit, 2:] - pieces[hit, :2]).T).sum()) if hit.any() else 0.0


def axis_lengths(a: Region, b: Region, start: np.ndarray) -> np.ndarray:
    """Lengths of what is in a and not in b along the rays from ``start`` towards larger x,
    smaller x, larger y and smaller y. Rays are cut where segments meet them; what lies on
    both sides of the middle of a piece decides."""
    seg = segments(a, b) - np.tile(start, 2)
    mids, sizes, ways = [], [], []
    for k, (x, y) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1))):
        u0, v0, u1, v1 = seg[:, 0] * x + seg[:, 1] * y, seg[:, 1] * x - seg[:, 0] * y, seg[:, 2] * x + seg[:, 3] * y, seg[:, 3] * x - seg[:, 2] * y
        through = v0 * v1 < 0
        at = u0[through] + (u1 - u0)[through] * v0[through] / (v0 - v1)[through]
        cuts = np.concatenate([[0.0], at, u0[np.abs(v0) < SNAP], u1[np.abs(v1) < SNAP]])
        cuts = np.unique(np.round(cuts[cuts >= 0], 9))
        mid = (cuts[1:] + cuts[:-1]) / 2
        mids.append(start + np.outer(mid, (x, y)))
        sizes.append(np.diff(cuts))
        ways.append(np.full(len(mid), k))
    points, size, way = np.concatenate(mids), np.concatenate(sizes), np.concatenate(ways)
    off = np.where(way[:, None] < 2, (0.0, 1e-6), (1e-6, 0.0))
    hit = np.ones(len(points), dtype=bool)
    for p in (points + off, points - off):
        hit &= inside(p, a) & ~inside(p, b)
    return np.bincount(way[hit], weights=size[hit], minlength=4)


def relate27(a: Region, b: Region, a_open: Region | None = None, b_open: Region | None = None) -> int:
    """Region, exterior and hull bands. ``a_open`` and ``b_open``: exteriors, where they are
    not just the outer rings."""
    ea, eb = solid(a) if a_open is None else a_open, solid(b) if b_open is None else b_open
    if all(len(x) == 1 and len(y) == 1 and is_convex(x[0][1]) for x, y in ((a, ea), (b, eb))):
        return relate(a, b) * ((1 << 18) + (1 << 9) + 1)  # filled and convex already
    return relate(a, b) << 18 | relate(ea, eb) << 9 | relate(hull(a), hull(b))


def band(a: Region, margin: float, arc: int = 16) -> Region:
    """The boundary widened by a margin, as capsules of its pieces."""
    out: Region = []
    for x0, y0, x1, y1 in boundary(a):
        t = math.atan2(y1 - y0, x1 - x0)
        k = np.linspace(-math.pi / 2, math.pi / 2, arc + 1)
        end = np.stack([x1 + margin * np.cos(t + k), y1 + margin * np.sin(t + k)], axis=1)
        start = np.stack([x0 + margin * np.cos(t + math.pi + k), y0 + margin * np.sin(t + math.pi + k)], axis=1)
        out.append(("+", np.concatenate([end, start])))
    return out


def relate_within(a: Region, b: Region, margin: float) -> int:
    """The nine bits with a boundary of a certain width: insides are what is deeper than
    the margin, outsides what is farther, and every cell is an area."""
    out, parts = EE, []
    for r in (a, b):
        w = band(r, margin)
        core = [*r, *(("-", x) for _, x in w)]
        full = [*r, *w]
        parts.append((core, w, full))
    (ca, wa, fa), (cb, wb, fb) = parts
    pieces = noded(segments(fa, fb))
    get = {n: sides(pieces, r) for n, r in (("ca", ca), ("wa", wa), ("fa", fa), ("cb", cb), ("wb", wb), ("fb", fb))}
    for bit, x, y in ((II, "ca", "cb"), (IB, "ca", "wb"), (IE, "ca", "-fb"), (BI, "wa", "cb"), (BB, "wa", "wb"), (BE, "wa", "-fb"), (EI, "-fa", "cb"), (EB, "-fa", "wb")):
        for s in (0, 1):
            u, v = (~get[n[1:]][s] if n[0] == "-" else get[n][s] for n in (x, y))
            if (u & v).any():
                out |= bit
                break
    return out


def aligned(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both rings about their mean centre, in the size of their mean box."""
    mid = (centroid(one) + centroid(two)) / 2
    sizes = np.ptp(one, axis=0), np.ptp(two, axis=0)
    mean = (sizes[0] + sizes[1]) / 2
    return tuple((r - centroid(r)) * (mean / np.maximum(s, 1e-12)) + mid for r, s in zip((one, two), sizes, strict=True))


def by_nearest(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Each point of the first ring half-way to its nearest point of the second."""
    seg = np.hstack([two, np.roll(two, -1, axis=0)])
    r = seg[:, 2:] - seg[:, :2]
    d = one[:, None] - seg[None, :, :2]
    t = np.clip((d * r[None]).sum(axis=2) / np.maximum((r * r).sum(axis=1), 1e-300)[None], 0, 1)
    foot = seg[None, :, :2] + r[None] * t[:, :, None]
    best = np.hypot(*np.moveaxis(one[:, None] - foot, 2, 0)).argmin(axis=1)
    return (one + foot[np.arange(len(one)), best]) / 2


def interpolate(one: np.ndarray, two: np.ndarray | None) -> np.ndarray:
    """The ring half-way by nearest points, which may cross itself. With no second ring, a
    copy."""
    return one.copy() if two is None or not len(two) else by_nearest(*aligned(one, two))


def shrink(ring: np.ndarray) -> np.ndarray:
    """Half-way to the centre; a quarter of the area."""
    return (ring + centroid(ring)) / 2
