"""The neighbours' search by tiles: rows a tile and cell, fine tiles where stations lie thick, many at one place."""

import math
import random

import pytest

from streamweave.operators import nearest


def by_hand(pts, sts, k, allowed=lambda s: True):
    return {(i, s, n) for i, x, y in pts for n, (_, s) in enumerate(sorted((math.dist((x, y), (a, b)), s) for s, a, b in sts if allowed(s))[:k], 1)}


def frames(spark, pts, sts):
    return spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(sts, "st int, sx double, sy double")


def test_points_go_down_in_tiles(spark, monkeypatch):
    """No table of the search has a row for each point and cell."""
    rng = random.Random(4)
    pts, sts = [(i, rng.random(), rng.random()) for i in range(1500)], [(i, rng.random(), rng.random()) for i in range(3000)]
    rows, write = [], nearest.Tables.write

    def counted(self, df, *folders):
        made = write(self, df, *folders)
        rows.append(made.count())
        return made

    monkeypatch.setattr(nearest.Tables, "write", counted)
    p, s = frames(spark, pts, sts)
    got = nearest.nearest_k(p, s, "id", "st", 3)
    assert {(r["id"], r["st"], r["nth"]) for r in got.collect()} == by_hand(pts, sts, 3)
    assert rows[-1] == 3 * len(pts) and max(rows[:-1]) <= max(len(pts), len(sts))


@pytest.mark.parametrize("meets", [0, 300])
def test_tiles_are_cut_finer_where_stations_lie_thick(spark, monkeypatch, meets):
    rng = random.Random(6)
    pts = [(i, rng.random(), rng.random()) for i in range(60)] + [(100 + i, 40.0 + i, 7.0) for i in range(30)]
    sts = [(i, rng.random(), rng.random()) for i in range(1500)] + [(9000 + i, 40.0 + 3 * i, 8.0) for i in range(9)]
    monkeypatch.setattr(nearest, "MEETS", meets)
    p, s = frames(spark, pts, sts)
    met = []
    got = nearest.nearest_k(p, s, "id", "st", 4, met=met)
    assert {(r["id"], r["st"], r["nth"]) for r in got.collect()} == by_hand(pts, sts, 4)
    assert 0 < met[0] <= 250 * len(pts)


def test_many_at_one_place(spark):
    pts = [(i, 1.0, 1.0) for i in range(600)] + [(700, 3.0, 1.0)]
    sts = [(i, 1.0, 1.0) for i in range(500)] + [(600 + i, 2.0 + i, 1.0) for i in range(5)]
    p, s = frames(spark, pts, sts)
    s = s.selectExpr("*", "st % 2 AS kind")
    got = nearest.nearest_k(p, s, "id", "st", 3, without=("kind", [0, 1])).collect()
    for i in (0, 1):
        assert {(r["id"], r["st"], r[f"nth_{i}"]) for r in got if r[f"nth_{i}"] is not None} == by_hand(pts, sts, 3, lambda s, i=i: s % 2 != i)
