"""Several cases of one forest in one pass, against each case by itself."""

import random

import pytest
from pyspark.sql import functions as F

from streamweave.operators import forest, nearest


def _forest(rng, n):
    down = {i: rng.choice([None, i + 1, rng.randint(i + 1, n - 1)]) if i < n - 1 else None for i in range(n)}
    return down | {i: i + 1 for i in range(n // 3)}


@pytest.mark.parametrize("finish", [0, 40, None])
def test_gates_shut_values_one_by_one(spark, finish):
    rng = random.Random(8)
    n = 400
    down = _forest(rng, n)
    rows = [(i, down[i], rng.randint(0, 9), rng.randint(0, 9), rng.random() < 0.8, rng.random() < 0.3) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, down int, a long, b long, ga boolean, gb boolean")
    got = {r["node"]: (r["a"], r["b"]) for r in forest.contract(df, "id", "down", ["a", "b"], rooted=False, finish=finish, gates={"a": "ga", "b": "gb"}).collect()}
    a, b = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    for i, to, _, _, ga, gb in rows:  # edges go to greater ids
        if to is not None:
            a[to] += a[i] if ga else 0
            b[to] += b[i] if gb else 0
    assert got == {i: (a[i], b[i]) for i in range(n)}


def test_anchored_cases_equal_each_by_itself(spark):
    rng = random.Random(9)
    down = _forest(rng, 300)
    rows = [(i, down[i], float(rng.randint(1, 9)), float(rng.randint(50, 90)) if rng.random() < 0.1 else None, rng.randint(0, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, down int, local double, seen double, fold int").cache()
    cases = {f"q{f}": (F.col("local") + f, F.col("fold") != f) for f in range(3)}
    got = {r["id"]: r for r in forest.accumulate_anchored_each(df, "id", "down", cases, "seen").collect()}
    for f in range(3):
        alone = df.withColumn("mine", F.col("local") + f).withColumn("held", F.when(F.col("fold") != f, F.col("seen")))
        want = forest.accumulate_anchored(alone, "id", "down", "mine", "held").collect()
        assert len(want) == 300 and all(got[r["id"]][f"q{f}"] == r["total"] for r in want)


def test_neighbours_without_each_kind_in_one_search(spark):
    rng = random.Random(10)
    stations = [(i, rng.gauss(0, 1) if i % 2 else 5 + rng.gauss(0, 0.01), rng.random(), rng.choice([0, 0, 0, 1, 2, None])) for i in range(300)]
    points = [(i, rng.uniform(-2, 7), rng.random()) for i in range(60)]
    s = spark.createDataFrame(stations, "s int, sx double, sy double, fold int")
    p = spark.createDataFrame(points, "p int, x double, y double")
    got = nearest.nearest_k(p, s, "p", "s", 4, without=("fold", [0, 1, 9])).collect()
    for i, f in enumerate((0, 1, 9)):
        have = sorted((r["p"], r[f"nth_{i}"], r["s"]) for r in got if r[f"nth_{i}"] is not None)
        want = []
        for q, x, y in points:
            best = sorted((((x - sx) ** 2 + (y - sy) ** 2) ** 0.5, t) for t, sx, sy, k in stations if k != f)[:4]
            want += [(q, n, t) for n, (_, t) in enumerate(best, 1)]
        assert have == sorted(want)


def test_places_are_searched_for_once(spark, monkeypatch):
    """Many reaches at few places: the neighbours' search sees the places, and every reach gets its flow."""
    from streamweave.operators import regional

    asked = []
    search = regional.nearest_k
    monkeypatch.setattr(regional, "nearest_k", lambda points, *a, **k: asked.append(points.count()) or search(points, *a, **k))
    reaches = spark.createDataFrame([(i, None, float(i % 3), 0.0, 1000.0) for i in range(60)] + [(60, None, None, 0.0, 1000.0)], "id int, down int, x double, y double, own_area double")
    posts = spark.createDataFrame([("a", 0, 0.0, 0.0, 2.0, 5.0), ("b", 2, 2.0, 0.0, 4.0, 7.0)], "s string, id int, sx double, sy double, specific double, q double")
    got = {r["id"]: r["q"] for r in regional.estimate_network(reaches, posts, "id", "down", "s", 1).collect()}
    assert asked == [3] and len(got) == 61
    assert got[0] == 5.0 and got[2] == 7.0 and got[3] == pytest.approx(2.0) and got[5] == pytest.approx(4.0) and got[60] == 0.0
