"""Ball-tree k-means against brute force and its SQL."""

import hashlib

import numpy as np
from oracle import connect, differences
from pyspark.sql import functions as F

from streamweave.llm import metric_trees
from streamweave.llm.registry import ORACLE_SQL


def brute(rows, clusters, rounds, seed, scale=256):
    kept = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v, i) for i, v in rows)
    points = [(i, np.floor(scale * np.array(v)).astype(int)) for _, v, i in kept]
    centroids = [p.copy() for _, p in points[:clusters]]
    assign = lambda: [min((int(((p - c) ** 2).sum()), k) for k, c in enumerate(centroids)) for _, p in points]
    for _ in range(rounds):
        near = assign()
        for k in range(len(centroids)):
            own = [p for (_, p), (_, at) in zip(points, near, strict=True) if at == k]
            if own:
                centroids[k] = np.array([int(s) // len(own) for s in np.sum(own, axis=0)])
    near = assign()
    each = {k: sum(d for d, at in near if at == k) for k in range(len(centroids))}
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i is not None, i or 0, k, d, each[k], sum(each.values()), told[k]) for (i, _), (d, k) in zip(points, near, strict=True))


def got(df):
    return sorted((r["vec_id"] is not None, r["vec_id"] or 0, *r[1:]) for r in df.collect())


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    assert differences(metric_trees.op11_centroid_clustering(spark, d), connect(d), ORACLE_SQL["op11_centroid_clustering"]) == []


def test_clustered_ties_and_repeats(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(5, 3)) * 40
    rows = [(i, (centres[i % 5] + r.normal(size=3)).tolist()) for i in range(700)]
    rows += [(1000 + i, [float(i % 4), 0.0, 0.0]) for i in range(200)]  # ties
    rows += [(7, rows[7][1])] * 3 + [(None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert got(metric_trees.cluster_vectors(df, 9, 4, 2, 3)) == brute(rows, 9, 4, 2)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [-0.001, 2.5]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("Cluster", F.lit("x")).withColumn("distance", F.lit(1))
    out = metric_trees.cluster_vectors(df, 40, 5, 2, 2)
    assert [r["vec_id"] for r in out.orderBy("vec_id").collect()] == [1, 8]
    assert got(out) == brute([(1, [1.0, 2.0]), (8, [float(np.float32(-0.001)), 2.5])], 40, 5, 2)
    assert metric_trees.cluster_vectors(df.limit(0), 40, 5, 2, 2).count() == 0
    assert metric_trees.cluster_vectors(df.where("vec_id in (2, 7)"), 40, 5, 2, 2).columns == out.columns


def test_balls_are_assigned_whole():
    r = np.random.default_rng(5)
    centres = r.integers(-(1 << 20), 1 << 20, size=(8, 16))
    points = (centres[r.integers(0, 8, 4096)] + r.integers(-3000, 3000, size=(4096, 16))).astype(np.int64)
    tree, order = metric_trees.Tree.build(points)
    assert (tree.points == points[order]).all() and (tree.sums[0] == points.sum(axis=0)).all()
    cluster, balls = tree.nearest(centres)
    assert (cluster == ((tree.points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(tree.last[n] - tree.first[n] for n, _ in balls) > 0.95 * len(points) and len(balls) < 100
    for n, k in balls:
        own = tree.points[tree.first[n] : tree.last[n]]
        assert (own.sum(axis=0) == tree.sums[n]).all() and (cluster[tree.first[n] : tree.last[n]] == k).all()


def test_large_components_are_exact():
    r = np.random.default_rng(6)
    points, centroids = r.integers(-(1 << 27), 1 << 27, size=(300, 4)), r.integers(-(1 << 27), 1 << 27, size=(7, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids] for p in points]
    assert metric_trees.squared(points, centroids).tolist() == want
    tree, _ = metric_trees.Tree.build(points)
    assert (tree.nearest(centroids)[0] == metric_trees.squared(tree.points, centroids).argmin(axis=1)).all()
