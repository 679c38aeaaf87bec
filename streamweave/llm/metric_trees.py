"""K-means over partition-local ball trees (operator 11).

Each task reads its vectors in slices and builds a ball tree over each: a node
holds its count, its integer sum (whose quotient is the ball's centre) and the
radius around that centre.  Trees are written once to the shared folder.  In a
round the centroids go to all tasks; by the triangle inequality a centroid that is
further from a ball's centre than the nearest one by more than two radii is the
nearest of no point in it, so balls with one centroid left add their count and sum
whole, and only leaves with several left look at their points.  Tasks return one
sum a cluster, so what is shuffled doesn't grow with the vectors.

All that decides is exact: components are integers, squared distances too, and
balls are only decided with room for what rounding their centre and radius may err.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.functions.shipping import ship_package
from streamweave.llm import worker
from streamweave.llm.common import cut, table

#: Points of a tree, and of a leaf that isn't split further.
SLICE, LEAF = 4096, 32
#: Components up to which doubles hold every step of a squared distance exactly, and up to which longs do.
DOUBLE_EXACT, LONG_EXACT = 1 << 21, 1 << 27

TREES = "ids array<long>, points binary, first array<int>, last array<int>, child array<int>, radius array<double>, sums binary"


class Tree:
    """Points (in the order of the leaves) and nodes; `child` is a node's first child (the second follows it), 0 for leaves."""

    def __init__(self, points: np.ndarray, first, last, child, radius, sums):
        self.points, self.first, self.last, self.child, self.radius, self.sums = points, first, last, child, radius, sums

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree over int64 points, and the order in which it holds them."""
        order = np.arange(len(points))
        first, last, child, radius, sums = [0], [len(points)], [0], [], []
        at = 0
        while at < len(first):
            a, b = first[at], last[at]
            own = points[order[a:b]]
            total = own.sum(axis=0)
            centre = total / (b - a)
            off = own - centre
            far = np.einsum("ij,ij->i", off, off)
            sums.append(total)
            radius.append(float(np.sqrt(far.max())))
            if b - a > LEAF and far.max() > 0:
                one = own[far.argmax()]
                away = own - one
                other = own[np.einsum("ij,ij->i", away, away).argmax()]
                along = own @ (other - one)
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(along, half)]
                child[at] = len(first)
                first += [a, a + half]
                last += [a + half, b]
                child += [0, 0]
            at += 1
        made = cls(points[order], *(np.array(x, np.int32) for x in (first, last, child)), np.array(radius), np.array(sums, np.int64))
        return made, order

    def row(self, ids: list) -> dict:
        return {"ids": ids, "points": self.points.astype("<i4").tobytes(), "first": self.first, "last": self.last, "child": self.child, "radius": self.radius, "sums": self.sums.astype("<i8").tobytes()}

    @classmethod
    def of(cls, row: dict) -> Tree:
        first = np.array(row["first"], np.int32)
        sums = np.frombuffer(row["sums"], "<i8").reshape(len(first), -1)
        points = np.frombuffer(row["points"], "<i4").reshape(-1, sums.shape[1]).astype(np.int64)
        return cls(points, first, np.array(row["last"], np.int32), np.array(row["child"], np.int32), np.array(row["radius"]), sums)

    def settled(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
        """(whole balls as (node, centroid), leaves as (node, centroids that may be nearest)); together they hold each point once."""
        centres = self.sums / (self.last - self.first)[:, None]
        known = centroids.astype(float)
        own, their = np.einsum("ij,ij->i", centres, centres), np.einsum("ij,ij->i", known, known)
        apart = np.sqrt(np.maximum(own[:, None] + their - 2 * (centres @ known.T), 0))
        room = 1e-6 * (1 + np.sqrt(own.max() + their.max()))
        may = apart - 2 * self.radius[:, None] <= apart.min(axis=1, keepdims=True) + room
        alone = may.sum(axis=1) == 1
        balls, leaves, stack = [], [], [0]
        while stack:
            node = stack.pop()
            if alone[node]:
                balls.append((node, int(may[node].argmax())))
            elif self.child[node]:
                stack += [self.child[node], self.child[node] + 1]
            else:
                leaves.append((node, may[node]))
        return balls, leaves

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Each point's centroid (the smallest number of ties), and the whole balls among them."""
        balls, leaves = self.settled(centroids)
        cluster = np.empty(len(self.points), np.int32)
        for node, k in balls:
            cluster[self.first[node] : self.last[node]] = k
        if leaves:
            rows = np.concatenate([np.arange(self.first[n], self.last[n]) for n, _ in leaves])
            may = np.repeat(np.array([m for _, m in leaves]), [self.last[n] - self.first[n] for n, _ in leaves], axis=0)
            columns = np.flatnonzero(may.any(axis=0))
            apart = squared(self.points[rows], centroids[columns])
            cluster[rows] = columns[np.where(may[:, columns], apart, np.iinfo(np.int64).max).argmin(axis=1)]
        return cluster, balls


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x centroids, as int64."""
    top = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    if top <= DOUBLE_EXACT:
        p, c = points.astype(float), centroids.astype(float)
        return (np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", c, c) - 2 * (p @ c.T)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    found = np.floor(scale * values.astype(float))
    if np.abs(found).max(initial=0) > LONG_EXACT:
        raise ValueError(f"components beyond {LONG_EXACT / scale} have squared distances that no long holds")
    return found.astype(np.int64)


def usable(vector: Column, dims: int) -> Column:
    """Exactly `dims` components, none null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))), F.lit(False))


def _task(operator: str, function):
    """A mapInArrow function that frees what other operators left in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin(operator)
        yield from function(batches)

    return run


def plant(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """Ball trees over the rows (vec_id, vector), a row for each slice of a partition; cut."""
    ship_package(vectors.sparkSession)
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("child", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64())), ("sums", pa.binary())])

    def grown(ids, values):
        tree, order = Tree.build(integers(values.reshape(-1, dims), scale))
        return pa.RecordBatch.from_pylist([tree.row([ids[i] for i in order])], kind)

    def build(batches):
        ids, values, held = [], [], 0
        for b in batches:
            for part in (b.slice(i, SLICE) for i in range(0, b.num_rows, SLICE)):
                if held and held + part.num_rows > SLICE:
                    yield grown(ids, np.concatenate(values))
                    ids, values, held = [], [], 0
                ids += part.column(0).to_pylist()
                values.append(np.asarray(part.column(1).flatten(), float))
                held += part.num_rows
        if held:
            yield grown(ids, np.concatenate(values))

    return cut(vectors.mapInArrow(_task("metric_trees", build), TREES))


def _totals(trees: DataFrame, centroids: np.ndarray, inertia: bool) -> dict[int, tuple[int, list[int]]]:
    """Count and sums of each centroid's points, or with `inertia` count and [sum of squared distances]; a row a cluster and dimension comes back."""
    shared = trees.sparkSession.sparkContext.broadcast(centroids)

    def add(batches):
        c = shared.value
        counts, sums = np.zeros(len(c), np.int64), np.zeros((len(c), 1 if inertia else c.shape[1]), np.int64)
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.of(row)
                cluster, balls = tree.nearest(c)
                if inertia:
                    far = ((tree.points - c[cluster]) ** 2).sum(axis=1)
                    if float(sums.sum(dtype=float)) + float(far.sum(dtype=float)) > 2.0**62:
                        raise ValueError("the sum of squared distances is beyond a long")
                    counts += np.bincount(cluster, minlength=len(c))
                    np.add.at(sums[:, 0], cluster, far)
                    continue
                rest = np.ones(len(cluster), bool)
                for node, k in balls:  # whole balls by what the tree holds
                    counts[k] += tree.last[node] - tree.first[node]
                    sums[k] += tree.sums[node]
                    rest[tree.first[node] : tree.last[node]] = False
                counts += np.bincount(cluster[rest], minlength=len(c))
                np.add.at(sums, cluster[rest], tree.points[rest])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    got = trees.mapInArrow(_task("metric_trees", add), "cluster int, n long, sums array<long>")
    wide = got.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(wide.collect(), key=lambda r: (r["cluster"], r["at"])):
        out.setdefault(r["cluster"], (int(r["n"]), []))[1].append(int(r["s"]))
    shared.destroy()
    return out


def cluster_vectors(df: DataFrame, clusters: int, rounds: int, seed: int, dims: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector.

    Components become floor(scale * x).  The first centroids are the vectors with the
    smallest SHA-256 of `seed:vec_id`; ties (repeated ids) go by the components.  In
    each round every vector goes to its nearest centroid (ties: the smaller number) and
    every centroid that has vectors to the floor of their mean; then they are assigned
    once more.  Vectors that are null, of another length or with null or non-finite
    components are left out; null ids are kept (their hash is that of `seed:`), repeated
    rows are so many vectors.  With fewer vectors than clusters there are as many
    centroids as vectors, an empty table gives an empty result.  Only the id and the
    vector are read.  Components beyond 2**27, or distances
    whose sum no long holds, are an error.
    """
    spark = df.sparkSession
    vectors = df.where(usable(F.col(vector_col), dims)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256))
    start = hashed.orderBy("hash", "vector").limit(clusters).collect()  # a row a cluster
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], out)
    centroids = integers(np.array([r["vector"] for r in start]), scale)
    trees = plant(vectors, dims, scale)
    for _ in range(rounds):
        for k, (n, sums) in _totals(trees, centroids, False).items():
            centroids[k] = [s // n for s in sums]
    inertia = {k: sums[0] for k, (_, sums) in _totals(trees, centroids, True).items()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shared = spark.sparkContext.broadcast((centroids, [inertia.get(k, 0) for k in range(len(centroids))], digests))
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def label(batches):
        c, each, told = shared.value
        whole = sum(each)
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.of(row)
                cluster, _ = tree.nearest(c)
                far = ((tree.points - c[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(far), pa.array([each[k] for k in cluster], pa.int64()), pa.array([whole] * len(cluster), pa.int64()), pa.array([told[k] for k in cluster])], names)

    return trees.mapInArrow(_task("metric_trees", label), out)


CLUSTERS, ROUNDS, SEED, DIMS = 40, 5, 2, 64


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, SEED, DIMS)


def oracle() -> str:
    """The same for DuckDB, every vector against every centroid."""
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT v, sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept) ORDER BY h, v LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        far = f"{dot('v', 'v')} - 2 * {dot('v', 'c')} + {dot('c', 'c')}"
        parts.append(f"a{i} AS MATERIALIZED (SELECT * FROM (SELECT rid, vec_id, v, c, k, {far} AS far FROM kept CROSS JOIN c{i}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY far, k) = 1)")
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY d) AS c FROM (SELECT k, d, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i}) GROUP BY k, d) GROUP BY k
  UNION ALL SELECT k, c FROM c{i} WHERE k NOT IN (SELECT k FROM a{i}))"""
            )
    text = "array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')"
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(far) OVER () AS BIGINT) AS inertia, sha256({text}) AS centroid_sha256 FROM a{ROUNDS}"""
