"""Operators on small literals: the cases that the tables don't hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamweave.functions.scalar import erfc, percent_change, shortest_turn, without_accents
from streamweave.operators import checks, codec, forest, nearest, permits, series, spatial, trend


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_mann_kendall_ties_and_constants(spark):
    rows = [("a", x, y) for x, y in enumerate([0.0, 0.0, 1.0, 0.0, 2.0])] + [("c", x, 3.0) for x in range(5)]
    got = {r["k"]: r for r in trend.mann_kendall_sen(frame(spark, rows, "k string, x int, y double"), "k", "x", "y").collect()}
    assert got["c"]["z"] == 0.0 and got["c"]["slope"] == 0.0
    s = sum((b > a) - (b < a) for i, a in enumerate([0, 0, 1, 0, 2]) for b in [0, 0, 1, 0, 2][i + 1 :])
    var = (5 * 4 * 15 - 3 * 2 * 11) / 18
    assert got["a"]["z"] == pytest.approx((s - 1) / math.sqrt(var))


def every_pair(x, y):
    d = [(b - a, q - p) for i, (a, p) in enumerate(zip(x, y)) for b, q in zip(x, y) if b > a]
    slopes = sorted(dy / dx for dx, dy in d)
    return sum((dy > 0) - (dy < 0) for _, dy in d), (slopes[(len(slopes) - 1) // 2] + slopes[len(slopes) // 2]) / 2 if slopes else None


@pytest.mark.parametrize("most", [512, 5])
def test_trend_counts_equal_every_pair(monkeypatch, most):
    monkeypatch.setattr(trend, "ALL_PAIRS", most)
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 70, 150):
        for x, y in ((np.arange(n), r.random(n)), (r.integers(0, max(1, n), n), r.integers(0, 4, n)), (r.integers(0, 5, n) * 3, r.normal(size=n) - np.arange(n) / 9), (np.zeros(n), r.random(n))):
            assert (trend.kendall_s(x, y), trend.sen_slope(x, y)) == every_pair(x.tolist(), y.tolist())


def test_a_long_series_runs(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("x"), (F.col("id") * 0.25 + F.sin(F.col("id") * 12.9)).alias("y"))
    got = trend.mann_kendall_sen(df, "k", "x", "y").first()
    assert got["n"] == 20_000 and got["slope"] == pytest.approx(0.25, abs=1e-6) and 0.999 < got["s"] / (20_000 * 19_999 / 2) <= 1


def test_sen_slope_with_gaps(spark):
    rows = [("a", x, 2.0 * x) for x in (1990, 1991, 1995, 2001)]
    assert trend.mann_kendall_sen(frame(spark, rows, "k string, x int, y double"), "k", "x", "y").first()["slope"] == pytest.approx(2.0)


def test_benjamini_hochberg(spark):
    rows = frame(spark, list(enumerate([0.01, 0.04, 0.03, 0.5])), "k int, p double")
    got = {r["k"]: r["q"] for r in trend.benjamini_hochberg(rows, "p", "k").collect()}
    assert got == pytest.approx({0: 0.04, 1: 0.16 / 3, 2: 0.16 / 3, 3: 0.5})


def test_erfc(spark):
    got = frame(spark, [(0.0,), (0.3,), (1.96,), (3.0,)], "x double").select("x", erfc(F.col("x")).alias("e")).collect()
    assert all(r["e"] == pytest.approx(math.erfc(r["x"]), abs=1e-12) for r in got)


def test_circular_mean(spark):
    rows = [("wrap", 12, 1.0), ("wrap", 1, 1.0), ("wrap", 2, 1.0), ("none", 3, 0.0), ("even", 1, 1.0), ("even", 7, 0.0)]
    got = {r["k"]: r["mean_month"] for r in series.circular_mean_month(frame(spark, rows, "k string, m int, w double"), ["k"], "m", "w").collect()}
    assert got["wrap"] == pytest.approx(1.0) or got["wrap"] == pytest.approx(13.0)
    assert got["none"] is None and got["even"] == pytest.approx(1.0)


def test_small_scalars(spark):
    row = frame(spark, [("Açaí São", -10.7, 0.0, 5.0)], "s string, d double, a double, b double").select(
        without_accents(F.col("s")).alias("plain"), shortest_turn(F.col("d")).alias("turn"), percent_change(F.col("a"), F.col("b")).alias("pct")
    ).first()
    assert row["plain"] == "Acai Sao" and row["turn"] == pytest.approx(1.3) and row["pct"] is None


def forest_of(n, seed):
    rng = random.Random(seed)
    return [(i, rng.randrange(i) if i and rng.random() > 0.05 else None, rng.random()) for i in range(n)]


def test_accumulate_matches_a_walk(spark):
    nodes = forest_of(300, 1)
    observed = {7: 5.0, 40: 1.0, 3: 2.0}
    df = frame(spark, [(i, d, v, observed.get(i)) for i, d, v in nodes], "id long, down long, v double, obs double")
    plain, anchored = {i: v for i, _, v in nodes}, {i: v for i, _, v in nodes}
    for i, d, _ in reversed(nodes):  # children have larger ids
        anchored[i] = observed.get(i, anchored[i])
        if d is not None:
            plain[d] += plain[i]
            anchored[d] += anchored[i]
    got = {r["id"]: r["v"] for r in forest.accumulate(df, "id", "down", ["v"]).collect()}
    assert got == pytest.approx(plain)
    got = {r["id"]: r["total"] for r in forest.accumulate_anchored(df, "id", "down", "v", "obs").collect()}
    assert got == pytest.approx(anchored)
    ends = {r["id"]: r["root"] for r in forest.roots(df, "id", "down").collect()}
    down = {i: d for i, d, _ in nodes}

    def walk(i, stop=lambda x: False):
        while down[i] is not None and not stop(i):
            i = down[i]
        return i

    assert ends == {i: walk(i) for i in down}
    owner = {r["id"]: r["owner"] for r in forest.nearest_anchor_downstream(df, "id", "down", F.col("id").isin(*observed)).collect()}
    assert owner == {i: (e if e in observed else None) for i in down for e in [walk(i, lambda x: x in observed)]}


def test_empty_forest(spark):
    df = frame(spark, [], "id long, down long, v double")
    assert forest.accumulate(df, "id", "down", ["v"]).count() == 0
    assert forest.roots(df, "id", "down").count() == 0


def nearest_by_hand(pts, sts, k, allowed=lambda i, s: True):
    return {(i, s, n) for i, x, y in pts for n, (_, s) in enumerate(sorted((math.dist((x, y), (a, b)), s) for s, a, b in sts if allowed(i, s))[:k], 1)}


@pytest.mark.parametrize("kind", ["even", "cluster"])
def test_nearest_k_equals_brute_force(spark, kind):
    rng = random.Random(3)
    spot = {"even": lambda: (rng.gauss(0, 1), rng.gauss(0, 1)), "cluster": lambda: (0.3 + rng.gauss(0, 1e-6), 0.3 + rng.gauss(0, 1e-6)) if rng.random() < 0.5 else (rng.gauss(0, 1), rng.gauss(0, 1))}[kind]
    pts = [(i, *spot()) for i in range(300)] + [(999, 50.0, 50.0), (1000, None, 1.0)]
    sts = [(i, *spot()) for i in range(2000)] + [(5000, 1e6, -1e6)] + [(6000 + i, 0.25, 0.25) for i in range(40)]  # a far one, and many in one place
    met = []
    p, s = frame(spark, pts, "id int, x double, y double"), frame(spark, sts, "st int, sx double, sy double")
    got = nearest.nearest_k(p, s, "id", "st", 5, met=met)
    assert {(r["id"], r["st"], r["nth"]) for r in got.collect()} == nearest_by_hand(pts[:-1], sts, 5)
    assert met[0] <= 250 * len(pts)  # a few leaves a point, not the cluster's thousand


def test_nearest_k_of_other_groups(spark):
    rng = random.Random(5)
    pts = [(i, rng.random(), rng.random()) for i in range(80)]
    p = frame(spark, pts, "id int, x double, y double").withColumn("mine", F.col("id") % 3)
    s = frame(spark, pts, "st int, sx double, sy double").withColumn("theirs", F.col("st") % 3)
    got = nearest.nearest_k(p, s, "id", "st", 4, ("mine", "theirs"))
    assert {(r["id"], r["st"], r["nth"]) for r in got.collect()} == nearest_by_hand(pts, pts, 4, lambda i, s: i % 3 != s % 3)
    few = nearest.nearest_k(p, s.where("st < 4"), "id", "st", 4, ("mine", "theirs"))
    assert {(r["id"], r["st"], r["nth"]) for r in few.collect()} == nearest_by_hand(pts, pts[:4], 4, lambda i, s: i % 3 != s % 3)
    assert nearest.nearest_k(p, s.limit(0), "id", "st", 4).count() == 0 and nearest.nearest_k(p.limit(0), s, "id", "st", 4).count() == 0


def test_douglas_peucker_keeps_within_tolerance():
    line = [{"x": i / 10, "y": math.sin(i / 10)} for i in range(100)]
    kept = [line[i] for i in codec.douglas_peucker(np.array([(p["x"], p["y"]) for p in line]), 0.05)]
    assert kept[0] == line[0] and kept[-1] == line[-1] and 2 < len(kept) < 40


def test_varint_extremes(spark):
    values = [0, 1, -1, 15, -15, 16, -16, 2**31, -(2**31), 2**62, -(2**62)]
    df = frame(spark, [(values,), ([],)], "v array<bigint>")
    rows = df.select("v", codec.decode_varint(codec.encode_varint(F.col("v"))).alias("b")).collect()
    assert all(r["v"] == r["b"] for r in rows)


def test_dedup_key_falls_back(spark):
    df = frame(spark, [(1, "a", 1), (2, "a", 2), (3, None, 3), (4, None, 3)], "n int, c string, x int")
    key = F.coalesce("c", F.col("x").cast("string"))
    got = {r["key"]: (r["n"], r["multiplicity"]) for r in series.dedup_with_count(df, key, ["n"], ["n"]).collect()}
    assert got == {"a": (1, 2), "3": (3, 2)}


def test_over_ceiling_needs_both(spark):
    loads = frame(spark, [("a", 10.0), ("b", 10.0), ("c", 10.0)], "k string, load double")
    ceil = frame(spark, [("a", 1.0), ("b", 1.0)], "k string, ceiling double")
    capt = frame(spark, [("a", 5.0), ("c", 5.0)], "k string, captured double")
    assert [r["k"] for r in permits.over_ceiling(loads, ceil, capt, "k").collect()] == ["a"]


def test_guards(spark):
    a = frame(spark, [(1, 1.0), (2, 2.0)], "k int, v double")
    checks.assert_same(a, a, "k", "v")
    with pytest.raises(ValueError):
        checks.assert_same(a, a.where("k = 1"), "k", "v")
    assert checks.search_names(frame(spark, [("Rio São",)], "n string"), "n", "s").count() == 0


def test_midpoint_and_quantise(spark):
    line = [(0.0, 0.0), (1.0, 0.0), (1.0, 3.0)]
    df = frame(spark, [([{"x": x, "y": y} for x, y in line],)], "p array<struct<x:double,y:double>>")
    m = df.select(spatial.line_midpoint(F.col("p")).alias("m"), spatial.quantise_line(F.col("p"), 0.1).alias("q")).first()
    assert (m["m"]["x"], m["m"]["y"]) == pytest.approx((1.0, 1.0))
    assert [(p["x"], p["y"]) for p in m["q"]] == [(0, 0), (1, 0)] or len(m["q"]) == 2


def test_snaps_and_counts_equal_all_pairs(spark):
    """Lines of many and of far away areas, codes that agree from afar, copies and ties; and no list of pairs is shuffled."""
    import random

    from streamweave.operators import spatial

    r = random.Random(12)
    at = lambda: round(r.random() * 0.6, 2)
    lines = [(i, at(), at(), at(), at(), float(r.choice([1, 2, 2.7, 3, 40, -2])), str(r.randint(1, 40))) for i in range(60)] + [(60, 0.9, 0.9, 0.9, 0.9, 0.0, "")]
    spots = [(i, at(), at(), float(r.choice([1, 2, 3, 50, -2, 0])), str(r.randint(1, 400))) for i in range(150)] + [(150, None, 0.1, 1.0, "1"), (151, 0.9, 0.9, 1.0, None), (152, 5.0, 5.0, 1.0, "1")]
    s = spark.createDataFrame(lines, "line long, x1 double, y1 double, x2 double, y2 double, la double, lc string").cache()
    p = spark.createDataFrame(spots, "id long, x double, y double, pa double, pc string").cache()
    c = F.col
    near = p.crossJoin(s).withColumn("distance", spatial.segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))).where("distance < 0.05").cache()
    first = lambda rows, *order: {x["id"]: x["line"] for x in spatial.first_per(rows, "id", *order, c("line")).collect()}
    got = lambda df: {x["id"]: x["line"] for x in df.collect()}
    assert got(spatial.snap_plain(p, s, "id", "line", 0.05)) == first(near, c("distance"))
    agrees = F.coalesce((F.length("pc") > 0) & (F.length("lc") > 0) & (c("pc").startswith(c("lc")) | c("lc").startswith(c("pc"))), F.lit(False))
    assert got(spatial.snap_prefix(p, s, "id", "line", "pc", "lc", 0.05)) == first(near.withColumn("a", agrees), c("a").desc(), c("distance"))
    ratio = F.abs(F.ln(c("pa") / F.nullif(c("la"), F.lit(0.0))))
    assert got(spatial.snap_station(p, s, "id", "line", "pa", "la", 0.05)) == first(near.withColumn("score", ratio + 10 * c("distance")).where(ratio <= 0.35), c("score"))
    counted = {x["line"]: x["points"] for x in spatial.count_near(p, s, "line", 0.05).collect()}
    assert counted == {x["line"]: x["count"] for x in near.groupBy("line").count().collect()}
    assert spatial.snap_plain(p, s.limit(0), "id", "line", 0.05).count() == 0


def test_formula_of_a_pair_stays_short_enough_to_compile(spark):
    from streamweave.operators import spatial

    p = spark.range(5).select("id", (F.col("id") / 100).alias("x"), F.lit(0.0).alias("y"))
    s = spark.range(5).select(F.col("id").alias("line"), (F.col("id") / 100).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.1).alias("x2"), F.lit(0.1).alias("y2"))
    plan = spatial.near_segments(p, s, 0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert "sqrt" not in plan.lower().split("join inner")[1].split("\n")[0].lower()
