"""Polygon overlays against per-polygon tests and whole grid cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from streamweave.operators import overlay, spatial


def inside(ring, x, y):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            odd = not odd
    return odd


def edges(spark, polygons):
    """Edges of [(key, layer, ring, hole)], interior to the left."""
    rows = [(k, i, layer, [{"x": float(x), "y": float(y)} for x, y in ring], hole) for i, (k, layer, ring, hole) in enumerate(polygons)]
    df = spark.createDataFrame(rows, "key string, ring int, layer int, points array<struct<x:double,y:double>>, hole boolean")
    got = overlay.edges_of_rings(df, "key", "ring", "points", F.col("hole"))
    return got.join(df.select("ring", "layer"), "ring").select("key", "layer", "x1", "y1", "x2", "y2")


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d)]


def blob(r, x, y, size, n):
    """A star-shaped ring."""
    at = [(i + 0.6 * r.random()) / n * 2 * math.pi for i in range(n)]
    return [(x + size * (0.4 + r.random()) * math.cos(t), y + size * (0.4 + r.random()) * math.sin(t)) for t in at]


def rings(edges_df):
    got = {}
    for r in overlay.walked(edges_df).collect():
        got.setdefault((r["key"], r["ring"], r["hole"]), []).append((r["position"], r["x"], r["y"]))
    for points in got.values():
        assert sorted(p[0] for p in points) == list(range(len(points)))
    return {k: [p[1:] for p in sorted(v)] for k, v in got.items()}


def shoelace(ring):
    return sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def test_boxes_on_a_grid(spark):
    """Shared borders, equal boxes, corners that touch, holes: areas and borders are counted in whole cells."""
    r = random.Random(3)
    polygons, cells = [], {}
    for key in "ab":
        for _ in range(40):
            x, y, w, h = r.randrange(30), r.randrange(30), r.randrange(1, 7), r.randrange(1, 7)
            ring = box(x, y, x + w, y + h)
            polygons.append((key, 0, ring if r.random() < 0.5 else ring[::-1], False))
            cells.setdefault(key, set()).update((i, j) for i in range(x, x + w) for j in range(y, y + h))
    polygons += [("c", 0, box(0, 0, 9, 9), False), ("c", 0, box(2, 2, 5, 5), True), ("c", 0, box(9, 9, 12, 12), False), ("c", 0, box(0, 0, 9, 9)[::-1], False), ("c", 0, box(2, 2, 5, 5), True)]
    cells["c"] = {(i, j) for i in range(9) for j in range(9) if not (2 <= i < 5 and 2 <= j < 5)} | {(i, j) for i in range(9, 12) for j in range(9, 12)}
    made = overlay.overlay(edges(spark, polygons))
    got = {x["key"]: (round(x["area"], 6), round(x["perimeter"], 6)) for x in overlay.area(made).collect()}
    border = lambda own: sum((i + a, j + b) not in own for i, j in own for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    assert got == {k: (len(v), border(v)) for k, v in cells.items()}
    walked = rings(made)
    for key, own in cells.items():
        assert sum(shoelace(v) for k, v in walked.items() if k[0] == key) == pytest.approx(len(own))
    assert all((shoelace(v) < 0) == k[2] for k, v in walked.items())
    assert [len(v) for k, v in walked.items() if k[0] == "c" and k[2]] == [4]


@pytest.mark.parametrize("size, rules", [(None, "di"), (0.7, "u")])
def test_blobs_cover_what_each_covers(spark, size, rules):
    r = random.Random(8)
    layers = [[blob(r, r.random() * 10, r.random() * 10, 1.5, r.randrange(3, 9)) for _ in range(25)] for _ in range(2)]
    given = edges(spark, [("k", i, ring, False) for i, own in enumerate(layers) for ring in own])
    places = [(r.random() * 12 - 1, r.random() * 12 - 1) for _ in range(1500)]
    covered = [[any(inside(ring, x, y) for ring in own) for own in layers] for x, y in places]
    known = {"u": (overlay.union, lambda a, b: a or b), "i": (overlay.intersection, lambda a, b: a and b), "d": (overlay.difference, lambda a, b: a and not b)}
    for rule, told in (known[r] for r in rules):
        made = overlay.overlay(given, rule, size)
        walked = rings(made)
        for (x, y), (a, b) in zip(places, covered, strict=True):
            assert sum(inside(ring, x, y) != hole for (_, _, hole), ring in walked.items() if not hole) - sum(inside(ring, x, y) for (_, _, hole), ring in walked.items() if hole) == told(a, b)
        assert overlay.area(made).first()["area"] == pytest.approx(sum(map(shoelace, walked.values())))


def test_clip(spark):
    r = random.Random(9)
    given = [(str(i), 0, blob(r, r.random() * 6, r.random() * 6, 2, 7), False) for i in range(30)]
    made = rings(overlay.clip_box(edges(spark, given).drop("layer"), (1, 1, 5, 4)))
    for k, _, ring, _ in given:
        for _ in range(60):
            x, y = r.random() * 8 - 1, r.random() * 8 - 1
            found = [own for (key, _, _), own in made.items() if key == k]
            assert any(inside(own, x, y) for own in found) == (inside(ring, x, y) and 1 < x < 5 and 1 < y < 4)
    assert overlay.clip_box(edges(spark, given).drop("layer").limit(0), (1, 1, 5, 4)).count() == 0


def test_places_meet_only_their_cell(spark):
    """A place meets as many edges of a circle of 20,000 as of one of 1,000, and the answers are right."""
    r = random.Random(4)
    spots = spark.createDataFrame([(i, r.uniform(-1.2, 1.2), r.uniform(-1.2, 1.2)) for i in range(400)], "id long, x double, y double")
    most = []
    for n in (1000, 20_000):
        angle = lambda i: F.col(i) * (2 * math.pi / n)  # noqa: B023, E731
        edges = spark.range(n).select(F.lit(0).alias("ring"), F.cos(angle("id")).alias("x1"), F.sin(angle("id")).alias("y1"), F.cos(angle("id") + 2 * math.pi / n).alias("x2"), F.sin(angle("id") + 2 * math.pi / n).alias("y2"))
        got = overlay.in_polygon(spots, edges, "id").join(spots, "id").collect()
        assert all(x["inside"] == (math.hypot(x["x"], x["y"]) < 1) for x in got)
        size = overlay.cell_size(edges)
        cells = spots.select(F.lit(0).alias("key"), "id", "x", "y", F.lit(None).cast("long").alias("segment"), overlay._cell(F.col("x"), size, overlay.SHIFT_X).alias("cx"), overlay._cell(F.col("y"), size, overlay.SHIFT_Y).alias("cy"))
        segments = edges.select(F.lit(0).alias("key"), F.lit(None).cast("long").alias("segment"), "x1", "y1", "x2", "y2", F.lit(1).alias("n0"), F.lit(0).alias("n1"))
        most.append(overlay._passed(cells, segments, "id", size).count())
    assert max(most) <= 2 * 400


def test_cells_deep_inside_are_not_looked_into(spark):
    """Where many polygons lie on one another no edges are paired, however many they are; the border stays the same."""
    r = random.Random(6)
    made = [blob(r, r.gauss(0, 1), r.gauss(0, 1), 1.2, 5) for _ in range(120)]
    given = edges(spark, [("k", 0, ring, False) for ring in made])
    size = overlay.cell_size(given)
    all_of = overlay.pieces(given, size, 9)
    known = overlay.pieces(given, size / overlay.FINER, 9, overlay.union)
    assert known.count() < all_of.count() / 2
    slow, quick = (overlay.area(overlay.overlay(given, rule)).first() for rule in (lambda a, b: (a > 0) | (b > 0), overlay.union))
    assert quick["area"] == pytest.approx(slow["area"], abs=1e-6) and quick["perimeter"] == pytest.approx(slow["perimeter"], abs=1e-6)


def test_a_clip_over_covered_ground_pairs_only_its_box(spark):
    """Where a clip's box passes over thickly covered ground, the edges below it aren't paired, with one another or with the box."""
    r = random.Random(6)
    ground = edges(spark, [("k", 0, blob(r, r.gauss(0, 1), r.gauss(0, 1), 1.2, 5), False) for _ in range(120)])
    both = ground.unionByName(edges(spark, [("k", 1, box(-0.9, -0.7, 1.1, 0.8), False)]))
    size = overlay.cell_size(both) / overlay.FINER
    made = overlay.pieces(both, size, 9, overlay.intersection)
    assert made.count() < both.count() + 30
    assert {(x["n0"], x["n1"]) for x in made.where("whole").select("n0", "n1").distinct().collect()} == {(0, 1), (0, -1)}
    got = overlay.area(overlay.clip_box(ground.drop("layer"), (-0.9, -0.7, 1.1, 0.8))).first()
    assert got["area"] == pytest.approx(3.0, abs=1e-6) and got["perimeter"] == pytest.approx(7.0, abs=1e-6)


def test_layers_share_borders(spark):
    """Edges and parts of edges that lie on edges of the other layer, thick and thin: counted in whole cells, by every rule."""
    r = random.Random(12)
    polygons, cells = [], [set(), set()]
    for layer, n in ((0, 60), (1, 12)):
        for _ in range(n):
            x, y, w, h = r.randrange(9), r.randrange(9), r.randrange(1, 6), r.randrange(1, 6)
            polygons.append(("k", layer, box(x, y, x + w, y + h), False))
            cells[layer].update((i, j) for i in range(x, x + w) for j in range(y, y + h))
    given = edges(spark, polygons)
    border = lambda own: sum((i + a, j + b) not in own for i, j in own for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    for rule, own in ((overlay.union, cells[0] | cells[1]), (overlay.intersection, cells[0] & cells[1]), (overlay.difference, cells[0] - cells[1])):
        got = overlay.area(overlay.overlay(given, rule)).first()
        assert (got and (round(got["area"], 6), round(got["perimeter"], 6))) == (own and (len(own), border(own)) or None), rule.__name__
