"""Simplification with shared borders: no crossing, no sliver, within the tolerance."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from streamweave.operators import borders, codec, overlay


def shoelace(ring):
    return sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def frame(spark, rings):
    return spark.createDataFrame([(k, r, [{"x": float(x), "y": float(y)} for x, y in p]) for (k, r), p in rings.items()], "key string, ring int, points array<struct<x:double,y:double>>")


def simplified(spark, rings, tolerance):
    return {(r["key"], r["ring"]): [(p["x"], p["y"]) for p in r["points"]] for r in borders.simplify_shared(frame(spark, rings), tolerance).collect()}


def wiggle(r, a, b, n, size):
    """Points from a to b (without b) along a wiggling line."""
    (x1, y1), (x2, y2) = a, b
    out = [a]
    for i in range(1, n):
        t = i / n
        out.append((round(x1 + t * (x2 - x1) + r.uniform(-size, size), 6), round(y1 + t * (y2 - y1) + r.uniform(-size, size), 6)))
    return out


def mosaic(r, n, steps, size):
    """n x n neighbouring cells whose common borders wiggle."""
    corner = {(i, j): (float(i), float(j)) for i in range(n + 1) for j in range(n + 1)}
    across = {(i, j): wiggle(r, corner[i, j], corner[i + 1, j], steps, size) + [corner[i + 1, j]] for i in range(n) for j in range(n + 1)}
    upward = {(i, j): wiggle(r, corner[i, j], corner[i, j + 1], steps, size) + [corner[i, j + 1]] for i in range(n + 1) for j in range(n)}
    rings = {}
    for i in range(n):
        for j in range(n):
            rings[f"{i}-{j}", 0] = across[i, j][:-1] + upward[i + 1, j][:-1] + across[i, j + 1][::-1][:-1] + upward[i, j][::-1][:-1]
    return rings


def crossings(rings):
    """Pairs of different lines that share more than ends."""
    lines = {tuple(sorted((a, b))) for p in rings.values() for a, b in zip(p, p[1:] + p[:1], strict=True)}
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return [(s, t) for s, t in combinations(lines, 2) if not set(s) & set(t) and side(*s, t[0]) * side(*s, t[1]) <= 0 and side(*t, s[0]) * side(*t, s[1]) <= 0 and not (side(*s, t[0]) == 0 == side(*s, t[1]))]


def off(ring, p):
    best = math.inf
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / ((dx * dx + dy * dy) or 1)))
        best = min(best, math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy))
    return best


def test_worth_is_the_tolerance_that_drops():
    r = np.random.default_rng(3)
    for n in (2, 3, 12, 60):
        line = r.random((n, 2))
        value = borders.worth(line)
        for t in (0.01, 0.1, 0.3, 2.0):
            assert np.flatnonzero(value > t).tolist() == codec.douglas_peucker(line, t)
    ring = np.vstack([line, line[:1]])
    assert (borders.worth(ring) == np.inf).sum() == 4


@pytest.mark.parametrize("tolerance", [0.02, 0.3])
def test_mosaic(spark, tolerance):
    rings = mosaic(random.Random(2), 3, 9, 0.08)
    assert not crossings(rings)
    got = simplified(spark, rings, tolerance)
    assert set(got) == set(rings) and not crossings(got)
    assert sum(map(len, got.values())) < sum(map(len, rings.values()))
    for key, own in got.items():
        assert set(own) <= set(rings[key]) and len(own) >= 3
        assert all(off(own, p) <= tolerance + 1e-9 for p in rings[key])
    # No sliver: what the polygons hold in all is what their union holds, and inner borders are gone.
    union = overlay.overlay(overlay.edges_of_rings(frame(spark, got), "key", "ring", "points").selectExpr("'all' AS key", "0 AS layer", "x1", "y1", "x2", "y2"))
    assert overlay.area(union).first()["area"] == pytest.approx(sum(map(shoelace, got.values())))


def test_lines_that_would_cross_come_back(spark):
    """A spike reaches into a bay whose mouth the tolerance would close; an island lies in a hole alike it."""
    bay = [(0, 0), (10, 0), (10, 10), (6, 10), (5.5, 4), (5, 3), (4.5, 4), (4, 10), (0, 10)]
    spike = [(4.8, 20), (4.9, 5), (5, 4), (5.1, 5), (5.2, 20)]
    hole, island = [(1, 1), (2, 1), (2.5, 1.5), (2, 2), (1, 2)], [(1, 2), (2, 2), (2.5, 1.5), (2, 1), (1, 1)]
    rings = {("bay", 0): bay, ("bay", 1): hole, ("spike", 0): spike, ("island", 0): island}
    got = simplified(spark, rings, 8.0)
    assert not crossings(got) and all(len(v) >= 3 for v in got.values())
    assert set(got["bay", 1]) == set(got["island", 0])  # one arc
    assert any(y < 10 for _, y in got["bay", 0] if y not in (0,))  # the bay is still open


def test_small_and_closed_rings(spark):
    rings = {("a", 0): [(0, 0), (1, 0), (1, 1), (0, 0)], ("b", 0): [(5, 5), (5, 5), (6, 5), (6, 6), (5, 5)], ("c", 0): [(9, 9), (8, 8)], ("d", 0): []}
    got = simplified(spark, rings, 100.0)
    assert {k: set(v) for k, v in got.items()} == {("a", 0): {(0, 0), (1, 0), (1, 1)}, ("b", 0): {(5, 5), (6, 5), (6, 6)}}
    assert borders.simplify_shared(frame(spark, rings).limit(0), 1.0).count() == 0


def test_rings_of_one_file_are_spread(spark, monkeypatch):
    """One task may read all rings, but what grows out of them is many tasks' work."""
    files, write = [], borders.Tables.write
    monkeypatch.setattr(borders.Tables, "write", lambda self, df, *f: (made := write(self, df, *f), files.append(len(made.inputFiles())))[0])
    rings = frame(spark, mosaic(random.Random(5), 4, 4, 0.05)).coalesce(1)
    assert borders.simplify_shared(rings, 0.01).count() == 16 and files[0] >= 4


def test_own_ends_are_no_meetings(spark):
    """Lines that share ends only, a crossing, and an end that stands on another line."""
    lines = [(0, 0, 0, 4, 0, True), (1, 4, 0, 4, 4, False), (2, 4, 4, 0, 0, True), (3, 0, 0, 0, 4, False), (4, 2, -1, 2, 1, False), (5, 1, 0, 1, -3, False)]
    df = spark.createDataFrame([(0, e, *map(float, p), s) for e, *p, s in lines], "key int, edge int, x1 double, y1 double, x2 double, y2 double, short boolean")
    told = lambda **k: {(r["edge"], r["x"], r["y"]) for r in overlay.meetings(df, 3.0, 9, **k).collect()}
    assert told() == {(0, 2.0, 0.0), (4, 2.0, 0.0), (0, 1.0, 0.0)}
    assert told(asked="short") == {(0, 2.0, 0.0), (0, 1.0, 0.0)}


def test_a_ring_that_turns_back_parts_there(spark):
    """A spike out and back: its tip and its foot stay, however great the tolerance, and a long ring's points are all told."""
    spike = [(0, 0), (4, 0), (4, 4), (2, 4), (2, 7), (2, 4), (0, 4)]
    got = simplified(spark, {("a", 0): spike, ("b", 0): [(math.cos(i / 400), math.sin(i / 400)) for i in range(2500)]}, 0.0)
    assert {(2.0, 7.0), (2.0, 4.0)} <= set(got["a", 0]) and len(got["a", 0]) == 7
    assert len(set(got["b", 0])) == 2500
