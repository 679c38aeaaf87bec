"""Queries on polygons: union, clipping, membership, common borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamweave.operators import borders, overlay
from streamweave.plans.inputs import POINTS, points
from streamweave.sources.tables import table

Q, SQL = {}, {}


def query(sql):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _ring(df, key, *corners):
    """Edges of one ring a row, given by its corners' (x, y) columns."""
    spots = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    return overlay.edges_of_rings(df.select(key.alias("key"), F.monotonically_increasing_id().alias("ring"), spots.alias("points")), "key", "ring", "points")


def _boxes(spark, d):
    """A box of whole numbers about each point."""
    p = points(spark, d).select("id", (F.col("id") % 4).alias("grp"), F.floor(F.col("x") * 60).alias("a"), F.floor(F.col("y") * 60).alias("b"), (F.col("id") % 5 + 1).alias("w"), (F.col("id") % 3 + 1).alias("h"))
    c = F.col
    return p, [(c("a"), c("b")), (c("a") + c("w"), c("b")), (c("a") + c("w"), c("b") + c("h")), (c("a"), c("b") + c("h"))]


BOXES = f"{POINTS}, boxes AS (SELECT id, id % 4 AS grp, CAST(floor(x * 60) AS BIGINT) AS a, CAST(floor(y * 60) AS BIGINT) AS b, id % 5 + 1 AS w, id % 3 + 1 AS h FROM points)"


@query(f"""WITH {BOXES}, wide AS (SELECT grp, b, h, unnest(range(a, a + w)) AS i FROM boxes), cells AS (SELECT DISTINCT grp, i, unnest(range(b, b + h)) AS j FROM wide),
sides AS (SELECT c.grp, count(*) AS n FROM cells c CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(di, dj) LEFT JOIN cells o ON o.grp = c.grp AND o.i = c.i + di AND o.j = c.j + dj WHERE o.grp IS NULL GROUP BY 1)
SELECT grp AS key, CAST(count(*) AS DOUBLE) AS area, CAST(any_value(n) AS DOUBLE) AS perimeter FROM cells JOIN sides USING (grp) GROUP BY grp""")
def union_area(spark, d):
    """Area and border of what overlapping, touching and repeated boxes cover together."""
    p, corners = _boxes(spark, d)
    edges = _ring(p, F.col("grp"), *corners).select("key", F.lit(0).alias("layer"), "x1", "y1", "x2", "y2")
    return overlay.area(overlay.overlay(edges)).select("key", F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"))


SHAPES = [((0.0, 0.0), (0.05, 0.01), (0.01, 0.06)), ((0.0, 0.0), (0.04, -0.02), (0.03, 0.05))]
INSIDE = " OR ".join(
    "(id % 2 = {k} AND {side})".format(k=k, side=" AND ".join(f"({x2} - ({x1})) * (py - (y + ({y1}))) - ({y2} - ({y1})) * (px - (x + ({x1}))) > 0" for (x1, y1), (x2, y2) in zip(s, s[1:] + s[:1], strict=True)))
    for k, s in enumerate(SHAPES)
)


def _triangles(spark, d):
    p = points(spark, d).where("id % 3 = 0")
    c = F.col
    at = lambda i, k: F.when(c("id") % 2 == 0, SHAPES[0][i][k]).otherwise(SHAPES[1][i][k])
    return _ring(p, F.lit(0), *[(c("x") + at(i, 0), c("y") + at(i, 1)) for i in range(3)])


def _holds(spark, d, edges):
    """Whether the boundary's inside holds each of the other points."""
    short = edges.select(F.lit(0).alias("ring"), "x1", "y1", "x2", "y2")
    p = points(spark, d).where("id % 3 <> 0").select("id", "x", "y")
    return overlay.in_polygon(p, short, "id")


@query(f"WITH {POINTS}, spots AS (SELECT id AS pid, x AS px, y AS py FROM points WHERE id % 3 <> 0) SELECT pid AS id, coalesce(bool_or({INSIDE}), false) AS inside FROM spots LEFT JOIN (SELECT * FROM points WHERE id % 3 = 0) ON true GROUP BY pid")
def union_membership(spark, d):
    """Whether a union of overlapping triangles holds a point; SQL asks every triangle."""
    edges = _triangles(spark, d).select("key", F.lit(0).alias("layer"), "x1", "y1", "x2", "y2")
    return _holds(spark, d, overlay.overlay(edges))


BOX = (-0.1, -0.08, 0.15, 0.12)


@query(f"WITH {POINTS}, spots AS (SELECT id AS pid, x AS px, y AS py FROM points WHERE id % 3 <> 0) SELECT pid AS id, coalesce(bool_or({INSIDE}), false) AND any_value(px > {BOX[0]} AND px < {BOX[2]} AND py > {BOX[1]} AND py < {BOX[3]}) AS inside FROM spots LEFT JOIN (SELECT * FROM points WHERE id % 3 = 0) ON true GROUP BY pid")
def clip_membership(spark, d):
    """Whether the triangles, cut off at a box, hold a point."""
    return _holds(spark, d, overlay.clip_box(_triangles(spark, d), BOX))


@query(f"WITH {BOXES}, cutoff AS (SELECT id AS key, greatest(0, least(a + w, 3.5) - greatest(a, -2.25)) * greatest(0, least(b + h, 2.75) - greatest(b, -3.5)) AS area FROM boxes) SELECT key, round(CAST(area AS DOUBLE), 6) AS area FROM cutoff WHERE area > 0")
def clip_area(spark, d):
    """What each box keeps within another."""
    p, corners = _boxes(spark, d)
    return overlay.area(overlay.clip_box(_ring(p, F.col("id"), *corners), (-2.25, -3.5, 3.5, 2.75))).select("key", F.round("area", 6).alias("area"))


WIDE, TOLERANCE = 20, 0.05
MOSAIC = f"""cells AS (SELECT p_partkey AS key, p_partkey % {WIDE} AS i, p_partkey // {WIDE} AS j FROM part),
bends AS (SELECT key, unnest([-((i * 7 + j * 13) % 11 - 5), (i * 7 + (j + 1) * 13) % 11 - 5, -((i * 5 + j * 3) % 11 - 5), ((i + 1) * 5 + j * 3) % 11 - 5]) * 0.02 AS bend FROM cells)"""


@query(f"""WITH {MOSAIC} SELECT key, 8 AS before, CAST(4 + count(*) FILTER (abs(bend) > {TOLERANCE}) AS INTEGER) AS after, round(1 + coalesce(sum(bend / 2) FILTER (abs(bend) > {TOLERANCE}), 0), 6) AS area FROM bends GROUP BY key""")
def shared_borders(spark, d):
    """A mosaic of cells whose borders bend, simplified: small bends go on both sides alike, corners stay."""
    k = table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % WIDE).alias("i"), F.expr(f"p_partkey div {WIDE}").alias("j"))
    c = F.col
    level = lambda i, j: ((i * 7 + j * 13) % 11 - 5) * 0.02
    upright = lambda i, j: ((i * 5 + j * 3) % 11 - 5) * 0.02
    i, j = c("i"), c("j")
    corners = [(i, j), (i + 0.5, j + level(i, j)), (i + 1, j), (i + 1 + upright(i + 1, j), j + 0.5), (i + 1, j + 1), (i + 0.5, j + 1 + level(i, j + 1)), (i, j + 1), (i + upright(i, j), j + 0.5)]
    rings = k.select("key", F.lit(0).alias("ring"), F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners]).alias("points"))
    made = borders.simplify_shared(rings, TOLERANCE)
    area = overlay.area(overlay.edges_of_rings(made, "key", "ring", "points")).select("key", F.round("area", 6).alias("area"))
    return made.select("key", F.lit(8).alias("before"), F.size("points").alias("after")).join(area, "key")
