"""Polygon pairs with known relations, and properties of the kernel."""

import math
import random

import numpy as np
import pytest

from slicetopo.operators import kernel as K
from slicetopo.plans import definitions as D


def c(r, x=0.0, y=0.0, n=16):
    t = np.arange(n) * 2 * math.pi / n
    return np.round(np.stack([x + r * np.sin(t), y + r * np.cos(t)], axis=1), 2)


def b(w, x=0.0, y=0.0, h=None):
    h = h or w
    return np.array([(x + w / 2, y + h / 2), (x + w / 2, y - h / 2), (x - w / 2, y - h / 2), (x - w / 2, y + h / 2)])


def region(*parts):
    return [("+" if i == 0 else op, r) for i, (op, r) in enumerate(parts)]


def P(ring):
    return ("+", ring)


def M(ring):
    return ("-", ring)


def A(ring):
    return ("&", ring)


def name(bits):
    found = [d.name for d in D.DEFINITIONS if d.mask and bits & d.mask == d.value]
    return found[0] if found else "UNKNOWN"


SCENES = [
    ([P(c(3))], [P(c(2))], "CONTAINS"),
    ([P(c(3))], [P(c(1.5, 1.2))], "CONTAINS"),
    ([P(c(3)), M(c(2)), P(c(1.5))], [P(c(1))], "CONTAINS"),
    ([P(c(3)), M(c(1))], [P(c(2.5)), M(c(1.5))], "CONTAINS"),
    ([P(c(3)), M(c(2))], [P(c(1))], "SURROUNDS"),
    ([P(c(3)), M(c(2.5)), P(c(1))], [P(c(2)), M(c(1.5))], "SURROUNDS"),
    ([P(c(4, -4.5))], [P(c(4, 4.5))], "DISJOINT"),
    ([P(b(4, -2))], [P(b(4, 2))], "BORDERS"),
    ([P(b(6)), M(b(4))], [P(b(4))], "CONFINES"),
    ([P(b(6)), M(b(4))], [P(b(2, -1, -1))], "CONFINES"),
    ([P(b(4))], [P(b(2, -1, 0, 4))], "PARTITIONED"),
    ([P(b(6))], [P(b(4, -1))], "PARTITIONED"),
    ([P(c(3)), M(c(2)), P(c(1))], [P(c(1))], "PARTITIONED"),
    ([P(b(4))], [P(b(4, 2))], "OVERLAPS"),
    ([P(c(3)), M(c(2))], [P(c(1.5, 1))], "OVERLAPS"),
    ([P(c(3)), M(c(1.5))], [P(c(2))], "OVERLAPS"),
    ([P(c(3)), M(c(2)), P(c(1))], [P(c(2))], "OVERLAPS"),
    ([P(b(6))], [P(b(6))], "EQUAL"),
    ([P(c(1))], [P(c(3))], "WITHIN"),
    ([P(c(1))], [P(c(3)), M(c(2))], "ENCLOSED"),
    ([P(c(2)), M(b(4, 2))], [P(c(3)), M(c(2))], "CONFINED"),
    ([P(b(2, -1, 0, 4))], [P(b(4))], "PARTITIONS"),
    ([P(c(6, -6.5))], [P(c(3, -6.5)), P(c(3, 3.5))], "OVERLAPS"),
]


@pytest.mark.parametrize("a,b_,want", SCENES)
def test_scenes(a, b_, want):
    bits = K.relate27(a, b_)
    assert name(bits) == want
    assert K.relate27(b_, a) == D.transpose_int(bits)


def test_open_holes_shelter():
    outer = [P(c(3)), M(c(2.5)), M(c(2, 3.5))]
    assert name(K.relate27(outer, [P(c(1, 1))], a_open=[P(c(3)), M(c(2.5)), M(c(2, 3.5))])) == "SHELTERS"


def text(nine):
    return f"{nine:09b}"


def test_matrices():
    assert text(K.relate([P(b(6))], [P(b(4))])) == "111001001"
    assert text(K.relate([P(b(4))], [P(b(6))])) == "100100111"
    assert text(K.relate([P(c(1.5))], [P(c(3)), M(c(2)), P(c(1))])) == "111001111"


def test_boxes_match_the_closed_form():
    rng = random.Random(5)
    for _ in range(200):
        x = [sorted(rng.sample(range(7), 2)) for _ in range(4)]
        (ax0, ax1), (ay0, ay1), (bx0, bx1), (by0, by1) = x
        ox, oy = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
        want = K.II * (ox > 0 and oy > 0) + K.IE * (ax0 < bx0 or ax1 > bx1 or ay0 < by0 or ay1 > by1) + K.EI * (bx0 < ax0 or bx1 > ax1 or by0 < ay0 or by1 > ay1)
        want += K.BB * (({ax0, ax1} & {bx0, bx1} != set() and oy > 0) or ({ay0, ay1} & {by0, by1} != set() and ox > 0))
        box = lambda x0, x1, y0, y1: np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], dtype=float)
        p, q = box(ax0, ax1, ay0, ay1), box(bx0, bx1, by0, by1)
        assert K.relate([P(p)], [P(q)]) & (K.II | K.IE | K.EI | K.BB) == want
        assert abs(K.combined_area([[P(p)], [P(q)]], lambda u, v: u & v) - max(ox, 0) * max(oy, 0)) < 1e-6
        turn = lambda r: np.stack([-r[:, 1], r[:, 0]], axis=1) + 3.25
        assert K.relate([P(turn(p))], [P(turn(q))]) == K.relate([P(p)], [P(q)])


def test_measures():
    assert abs(K.area([P(b(6)), M(b(4))]) - 20) < 1e-6
    assert abs(K.distance([P(b(2, -3))], [P(b(2, 3))]) - 4) < 1e-9
    assert K.distance([P(b(4, -2))], [P(b(4, 2))]) == 0
    assert abs(K.hausdorff([P(b(4))], [P(b(2))]) - math.sqrt(2)) < 1e-9
    assert abs(K.boundary_distance([P(b(4))], [P(b(2))]) - 1) < 1e-9
    assert abs(K.ray_length([P(b(4))], [P(b(2))], np.array([0.0, 0.0]), np.array([9.0, 0.0])) - 1) < 1e-6
    assert K.is_simple(b(2)) and not K.is_simple(np.array([(0, 0), (2, 2), (2, 0), (0, 2.0)]))


def test_tolerance_zones():
    assert K.relate_within([P(b(4))], [P(b(4, 4.05))], 0.1) & (K.II | K.BB) == K.BB
    assert not K.relate_within([P(b(4))], [P(b(4, 4.05))], 0.01) & K.BB
    assert name(sum(K.relate_within([P(b(6))], [P(b(6, 0.02))], 0.05) << s for s in (18, 9, 0))) == "EQUAL"


def test_interpolation():
    assert np.allclose(np.sort(K.interpolate(b(2), b(2, 1, 1)), axis=0), np.sort(b(2, 0.5, 0.5), axis=0))
    assert abs(abs(K.ring_area(K.interpolate(b(1), b(3)))) - 4) < 1e-6
    assert abs(abs(K.ring_area(K.shrink(b(2)))) - 1) < 1e-6


def test_many_pairs_are_related_as_one_by_one():
    rng = np.random.default_rng(17)

    def some():
        out = []
        for _ in range(rng.integers(1, 5)):
            x, y, w, h = rng.integers(0, 7, 4)
            n = rng.integers(3, 9)
            turn = np.sort(rng.random(n)) * 2 * np.pi
            ring = np.array([(x, y), (x + w + 1, y), (x + w + 1, y + h + 1), (x, y + h + 1)], float) if rng.random() < 0.6 else np.stack([x + 3 * np.cos(turn), y + 3 * np.sin(turn)], axis=1)
            out.append((rng.choice(["+", "+", "-", "&"]) if out else "+", ring))
            if rng.random() < 0.2:
                out.append(("|", K.NO_RING))
        return out

    pairs = [(some(), some()) for _ in range(250)] + [([], some()), (some(), []), ([], [])]
    pairs += [(a, a) for a, _ in pairs[:20]]
    assert K.relate_many(pairs).tolist() == [K.relate(a, b) for a, b in pairs]
    assert K.relate_many([]).tolist() == []
    assert K.relate27_many(pairs[:80]).tolist() == [K.relate27(a, b) for a, b in pairs[:80]]
    assert np.allclose(K.common_areas(pairs[:80]), [K.combined_area([a, b], lambda u, v: u & v) for a, b in pairs[:80]])


def test_regions_keep_their_parts_when_stored():
    box = lambda x0, x1: np.array([(x0, 0), (x1, 0), (x1, 2), (x0, 2)], float)
    a = K.union([("+", box(0, 4)), ("-", box(1, 2))], [("+", box(6, 9)), ("&", box(5, 7))])
    assert K.area(a) == 8 and K.area(K.unpack(*K.pack(a))) == 8 and K.unpack(*K.pack([])) == []
    assert K.area(K.union([], a)) == 8 and K.area(K.solid(a)) == 10
    assert K.common_boundary([("+", box(0, 2))], [("+", box(2, 5))]) == (2.0, 8.0, 10.0)
