"""Union, intersection and clipping of polygons, as an overlay of segments.

Polygons come as edges (key, layer, x1, y1, x2, y2) with their interior to the left.
Edges are cut where they meet, cell of a grid by cell; pieces that lie on one
another become one, with the change of the winding number from its right to its
left.  A piece stays if one side of it is inside the result and the other isn't.
How often a place is covered is told by `winding`: running totals along the lines
of the grid give it for each cell's corner, and from there only the pieces of the
place's own cell count.  So neither a polygon nor a place is ever compared with all
others, and what is shuffled grows with the edges and the cells that they cross.

Coordinates are rounded to `digits` decimals, those of crossings too, so that the
pieces' ends agree; places nearer than that are one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamweave.operators.forest import ring_positions
from streamweave.operators.lineage import cut_lineage, spread
from streamweave.operators.ranking import numbered, running_total
from streamweave.operators.spatial import cell

#: The grid's lines lie beside round numbers, so that they hardly ever run along edges or through vertices.
SHIFT_X, SHIFT_Y = math.sqrt(2) / 3.7, math.sqrt(3) / 4.3


def _at(index: Column, size: float, shift: float) -> Column:
    return (index + F.lit(shift)) * F.lit(size)


def _cell(value: Column, size: float, shift: float) -> Column:
    return cell(value - F.lit(shift * size), size)


def crossed_cells(segments: DataFrame, size: float, room: float = 0.0) -> DataFrame:
    """Add (cx, cy) of each grid cell that a segment (x1, y1, x2, y2) touches or passes within `room`, and perhaps of a neighbour."""
    slack = F.lit(max(size * 1e-7, room))
    box = segments.withColumn("cx", F.explode(F.sequence(_cell(F.least("x1", "x2") - slack, size, SHIFT_X), _cell(F.greatest("x1", "x2") + slack, size, SHIFT_X))))
    dx = F.col("x2") - F.col("x1")
    share = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x - F.col("x1"), dx)))
    y = lambda x, end: F.when(dx != 0, F.col("y1") + share(x) * (F.col("y2") - F.col("y1"))).otherwise(F.col(end))
    left, right = y(_at(F.col("cx"), size, SHIFT_X) - slack, "y1"), y(_at(F.col("cx") + 1, size, SHIFT_X) + slack, "y2")
    return box.withColumn("cy", F.explode(F.sequence(_cell(F.least(left, right) - slack, size, SHIFT_Y), _cell(F.greatest(left, right) + slack, size, SHIFT_Y))))


def cell_size(edges: DataFrame) -> float:
    """Cells about twice as wide as edges are on average, and no more than about 4,096 along an edge."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    mean, longest = edges.agg(F.avg(length), F.max(length)).first()
    return max(2 * (mean or 0.0), (longest or 0.0) / 4096, 1e-9)


def edges_of_rings(rings: DataFrame, key: str, ring: str, points: str, hole: Column | None = None) -> DataFrame:
    """(key, ring, x1, y1, x2, y2) of rings given as arrays of (x, y), interior to the left.

    Rings are closed if they aren't; outer ones are turned anticlockwise, those where
    `hole` holds clockwise.  Rings of fewer than three points have no edges.
    """
    n = F.size(points)
    pairs = F.zip_with(points, F.concat(F.slice(points, 2, n), F.slice(points, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    double = F.aggregate("__steps", F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    turned = (double < 0) != F.coalesce(hole if hole is not None else F.lit(False), F.lit(False))
    # Out of a generator, so that the pairs are made once.
    steps = rings.where(n >= 3).withColumn("__steps", F.explode(F.array(pairs)))
    steps = steps.select(F.col(key).alias("key"), F.col(ring).alias("ring"), turned.alias("turned"), F.explode("__steps").alias("e"))
    one, two = (lambda f: F.when(F.col("turned"), F.col(f"e.b.{f}")).otherwise(F.col(f"e.a.{f}"))), (lambda f: F.when(F.col("turned"), F.col(f"e.a.{f}")).otherwise(F.col(f"e.b.{f}")))
    return steps.select("key", "ring", one("x").alias("x1"), one("y").alias("y1"), two("x").alias("x2"), two("y").alias("y2")).where("x1 <> x2 or y1 <> y2")


def meetings(edges: DataFrame, size: float, digits: int, within: DataFrame | None = None, asked: str | None = None) -> DataFrame:
    """(key, edge, x, y): where an edge (key, edge, x1, y1, x2, y2) meets others of its key, its own ends left out.

    An end of one on the other (within the rounding) cuts that one there; edges that
    cross elsewhere are both cut at the crossing.  With `within` only the cells (key, cx, cy, open0, open1) are looked into,
    and there only the edges (with n0, n1) that may bound the result, with `asked` (a boolean column) only what the edges meet where it holds.
    """
    edges = edges.withColumn("asked", F.col(asked) if asked else F.lit(True))
    held = crossed_cells(edges, size)
    held = held if within is None else held.join(within, ["key", "cx", "cy"]).where(_MATTERS)
    near = 10.0**-digits
    names = ("edge", "x1", "y1", "x2", "y2", "asked")
    other = held.select("key", "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in names])
    c = F.col
    # Edges have many cells, so the sizes are guessed too small for a broadcast.
    pairs = held.where("asked").join(other.hint("merge"), ["key", "cx", "cy"]).where("edge < o_edge or not o_asked").select("key", *names, *[f"o_{n}" for n in names])
    apart = (F.greatest("x1", "x2") + near < F.least("o_x1", "o_x2")) | (F.greatest("o_x1", "o_x2") + near < F.least("x1", "x2")) | (F.greatest("y1", "y2") + near < F.least("o_y1", "o_y2")) | (F.greatest("o_y1", "o_y2") + near < F.least("y1", "y2"))
    pairs = pairs.where(~apart)
    mine, theirs = [c(n) for n in names[1:5]], [c(f"o_{n}") for n in names[1:5]]
    ends = [(c("edge"), c("o_x1"), c("o_y1"), mine), (c("edge"), c("o_x2"), c("o_y2"), mine), (c("o_edge"), c("x1"), c("y1"), theirs), (c("o_edge"), c("x2"), c("y2"), theirs)]

    def share(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        """Where on the segment the point's nearest place is."""
        t = F.try_divide((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1), (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))

    ax, ay, bx, by = c("x2") - c("x1"), c("y2") - c("y1"), c("o_x2") - c("o_x1"), c("o_y2") - c("o_y1")
    det = ax * by - ay * bx
    t = F.try_divide((c("o_x1") - c("x1")) * by - (c("o_y1") - c("y1")) * bx, det)
    u = F.try_divide((c("o_x1") - c("x1")) * ay - (c("o_y1") - c("y1")) * ax, det)
    pairs = pairs.withColumns({"__t": t, "__u": u, **{f"__s{i}": share(px, py, *of) for i, (_, px, py, of) in enumerate(ends)}})
    pairs = pairs.withColumns({f"__d{i}": F.hypot(px - (of[0] + c(f"__s{i}") * (of[2] - of[0])), py - (of[1] + c(f"__s{i}") * (of[3] - of[1]))) for i, (_, px, py, of) in enumerate(ends)})
    # Out of a generator, so that no filter writes the formulas out again within the join, too long to compile.
    told = F.struct(*[(c(f"__d{i}") <= near).alias(f"h{i}") for i in range(4)], "__t", "__u")
    pairs = pairs.withColumn("m", F.explode(F.array(told)))
    none = ~(c("m.h0") | c("m.h1") | c("m.h2") | c("m.h3"))
    t, u = c("m.__t"), c("m.__u")
    crosses = F.coalesce(none & (t > 0) & (t < 1) & (u > 0) & (u < 1), F.lit(False))
    x, y = F.round(c("x1") + t * ax, digits), F.round(c("y1") + t * ay, digits)
    at_end = lambda px, py, of: ((px == of[0]) & (py == of[1])) | ((px == of[2]) & (py == of[3]))
    cuts = [*[(e, px, py, c(f"m.h{i}"), of) for i, (e, px, py, of) in enumerate(ends)], (c("edge"), x, y, crosses, mine), (c("o_edge"), x, y, crosses, theirs)]
    # What an edge meets at its own ends is most of all, and is left out before it is shuffled.
    hits = [(e, px, py, F.coalesce(hit, F.lit(False)) & ~at_end(px, py, of) & (c("o_asked") if of is theirs else F.lit(True))) for e, px, py, hit, of in cuts]
    listed = F.array(*[F.when(hit, F.struct(e.alias("edge"), px.alias("x"), py.alias("y"))) for e, px, py, hit in hits])
    return pairs.select("key", F.explode(F.filter(listed, lambda s: s.isNotNull())).alias("cut")).select("key", "cut.*").distinct()


#: Where an edge may bound the result: in cells where a layer may, and the edge changes that layer's winding number.
_MATTERS = "(open0 and n0 <> 0) or (open1 and n1 <> 0)"


def _open_cells(told: DataFrame, size: float, digits: int, inside: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, cx, cy, open0, open1): the cells with edges in which the result may begin or end, and at which layer's edges; cut.

    From a cell's corner a straight way leads to each place of the cell, and it meets each of the
    cell's edges once at most.  So the winding numbers differ from the corner's by no more than
    these edges weigh, and if the rule says the same at both ends of that range the
    cell lies wholly inside the result or outside it.  If it does for one layer's range, whatever the other layer's,
    that layer's edges bound nothing there: where a clip's box passes over thickly covered ground, only the box's own edges do.
    """
    c = F.col
    # Ends of pieces are rounded, so edges that pass that near count as well.
    weigh = crossed_cells(told, size, 4 * 10.0**-digits).groupBy("key", "cx", "cy").agg(F.sum(F.abs("n0")).alias("m0"), F.sum(F.abs("n1")).alias("m1"))
    at = _corners(weigh.select("key", "cx", "cy"), told, size)
    low, high = ([inside(c("b0") + i * c("m0"), c("b1") + j * c("m1")) for j in (-1, 1)] for i in (-1, 1))
    open0, open1 = (low[0] != high[0]) | (low[1] != high[1]), (low[0] != low[1]) | (high[0] != high[1])
    return cut_lineage(weigh.join(at, ["key", "cx", "cy"]).select("key", "cx", "cy", open0.alias("open0"), open1.alias("open1")).where("open0 or open1"))


def pieces(edges: DataFrame, size: float, digits: int, inside: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(key, x1, y1, x2, y2, n0, n1): edges (key, layer, x1 ...) cut where they meet, equal ones made one; cut.

    With `inside` (a rule of RULES) cells that lie wholly inside or outside the result aren't
    looked into, nor edges of a layer that can't bound it in the cell; pieces that touch a cell where they
    aren't looked at can't bound the result and have `whole` false: they may be uncut there.

    Pieces run upwards (or to the right, if level); `net` is, for each of the two layers, how
    much greater the winding number is to the left of it than to the right.  Pieces
    without a change are left out.
    """
    r = lambda c: F.round(c, digits).alias(c)
    given = edges.select("key", "layer", r("x1"), r("y1"), r("x2"), r("y2")).where("x1 <> x2 or y1 <> y2")
    up = (F.col("y2") > F.col("y1")) | ((F.col("y2") == F.col("y1")) & (F.col("x2") > F.col("x1")))
    way = F.when(up, 1).otherwise(-1)
    layer = lambda k: F.sum(F.when(F.col("layer") == k, way).otherwise(0)).alias(f"n{k}")
    first, last = F.when(up, F.struct("x1", "y1")).otherwise(F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"))), F.when(up, F.struct("x2", "y2")).otherwise(F.struct(F.col("x1").alias("x2"), F.col("y1").alias("y2")))
    upward = lambda df, *weights: df.select("key", first.alias("a"), last.alias("b"), *weights).select("key", "a.x1", "a.y1", "b.x2", "b.y2", *[w for w in ("n0", "n1")])
    whole = upward(given, *[F.when(F.col("layer") == k, way).otherwise(0).cast("long").alias(f"n{k}") for k in (0, 1)])
    whole = whole.groupBy("key", "x1", "y1", "x2", "y2").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    told = cut_lineage(spread(numbered(whole, "key", "x1", "y1", "x2", "y2", name="edge")))
    open_cells = _open_cells(told, size, digits, inside) if inside else None
    cuts = meetings(told, size, digits, open_cells).join(told.select("edge", "x1", "y1", "x2", "y2", "n0", "n1"), "edge")
    own = told.select("key", "edge", "n0", "n1", F.lit(0.0).alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y"), "x2", "y2")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / (dx * dx + dy * dy)
    stops = own.unionByName(cuts.select("key", "edge", "n0", "n1", along.alias("t"), "x", "y", "x2", "y2").where("t > 0 and t < 1"))
    order = Window.partitionBy("edge").orderBy("t", "x", "y")
    ends = stops.withColumn("nx", F.coalesce(F.lead("x").over(order), F.col("x2"))).withColumn("ny", F.coalesce(F.lead("y").over(order), F.col("y2")))
    short = ends.select("key", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("nx").alias("x2"), F.col("ny").alias("y2"), "n0", "n1").where("x1 <> x2 or y1 <> y2")
    flip = lambda n: F.when(up, F.col(n)).otherwise(-F.col(n)).alias(n)
    one = upward(short, flip("n0"), flip("n1")).groupBy("key", "x1", "y1", "x2", "y2").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    one = cut_lineage(spread(one.where("n0 <> 0 or n1 <> 0")))
    if not inside:
        return one
    names = ["key", "x1", "y1", "x2", "y2", "n0", "n1"]
    marked = crossed_cells(one, size).join(open_cells, ["key", "cx", "cy"], "left").groupBy(*names).agg(F.min(F.coalesce(F.expr(_MATTERS), F.lit(False))).alias("whole"))
    return cut_lineage(marked)


def _passed(places: DataFrame, segments: DataFrame, place: str, size: float) -> DataFrame:
    """The segments of each place's cell that pass its left side below the place (`upward`), or the way from there to the place (`onward`)."""
    c = F.col
    held = crossed_cells(segments, size).select("key", "cx", "cy", F.col("segment").alias("s"), "x1", "y1", "x2", "y2", "n0", "n1")
    left, floor = _at(c("cx"), size, SHIFT_X), _at(c("cy"), size, SHIFT_Y)
    y_at = c("y1") + F.try_divide((c("y2") - c("y1")) * (left - c("x1")), c("x2") - c("x1"))
    upward = ((c("x1") > left) != (c("x2") > left)) & (y_at > floor) & (y_at <= c("y"))
    x_at = c("x1") + F.try_divide((c("x2") - c("x1")) * (c("y") - c("y1")), c("y2") - c("y1"))
    onward = ((c("y1") > c("y")) != (c("y2") > c("y"))) & (x_at > left) & (x_at < c("x")) & ~F.coalesce(c("s") == c("segment"), F.lit(False))
    near = held.join(places.select("key", "cx", "cy", place, "segment", "x", "y"), ["key", "cx", "cy"])
    return near.withColumn("upward", F.coalesce(upward, F.lit(False))).withColumn("onward", F.coalesce(onward, F.lit(False)))


def _corners(corners: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """(key, cx, cy, b0, b1): the winding numbers at the lower left corner of each cell (key, cx, cy), by running totals along the grid's lines."""
    c = F.col
    lines = segments.where("y2 > y1")
    lines = lines.withColumn("cy", F.explode(F.sequence(_cell(c("y1"), size, SHIFT_Y), _cell(c("y2"), size, SHIFT_Y) + 1)))
    line = _at(c("cy"), size, SHIFT_Y)
    meets = lines.where((c("y1") > line) != (c("y2") > line)).withColumn("x", c("x1") + F.try_divide((c("x2") - c("x1")) * (line - c("y1")), c("y2") - c("y1")))
    weight = c("n0") + c("n1") * F.lit(1 << 24)  # both layers in one number; going to the right loses what is gained to the left
    # A row and cell has one number, so what is sorted is rows of cells, not segments.
    gained = meets.groupBy("key", "cy", _cell(c("x"), size, SHIFT_X).alias("cx")).agg(F.sum(-weight).alias("w"))
    events = gained.select("key", "cy", "cx", F.lit(True).alias("passed"), "w").unionByName(corners.select("key", "cy", "cx", F.lit(False).alias("passed"), F.lit(0).cast("long").alias("w")))
    at = running_total(events, c("w"), "key", "cy", "cx", "passed", name="base").where("not passed")
    base1 = F.round(c("base") / F.lit(1 << 24)).cast("long")
    return at.select("key", "cy", "cx", (c("base") - base1 * F.lit(1 << 24)).alias("b0"), base1.alias("b1"))


def winding(places: DataFrame, segments: DataFrame, place: str, size: float) -> DataFrame:
    """(place, w0, w1): how often each layer's polygons go round each place (key, place, x, y).

    Segments are (key, segment, x1, y1, x2, y2, n0, n1), upwards, with what the winding
    number gains from right to left.  Places with a `segment` lie on it and get the
    winding number to its left.  The way to a place leads from the corner of its
    cell up and then to the right, so only its cell's segments are met; the corner's number
    is a running total along the grid's line.
    """
    c = F.col
    here = places.withColumn("cx", _cell(c("x"), size, SHIFT_X)).withColumn("cy", _cell(c("y"), size, SHIFT_Y))
    corners = here.select("key", "cx", "cy").distinct()
    at = _corners(corners, segments, size)
    start = here.join(at, ["key", "cx", "cy"])
    near = _passed(start, segments, place, size)
    gain = lambda n: F.when(c("upward"), F.when(c("x2") > c("x1"), c(n)).otherwise(-c(n))).otherwise(0) - F.when(c("onward"), c(n)).otherwise(0)
    moved = near.where("upward or onward").groupBy("key", place).agg(F.sum(gain("n0")).alias("g0"), F.sum(gain("n1")).alias("g1"))
    return start.join(moved, ["key", place], "left").select("key", place, (c("b0") + F.coalesce("g0", F.lit(0))).alias("w0"), (c("b1") + F.coalesce("g1", F.lit(0))).alias("w1"))


def in_polygon(points: DataFrame, edges: DataFrame, point: str, size: float | None = None) -> DataFrame:
    """(point, inside): whether any of the simple rings (ring, x1, y1, x2, y2) holds the point (point, x, y).

    Rings may run either way and overlap, each is a polygon of its own.
    Points without a place are in none; points must be unique.
    """
    c = F.col
    turned = edges.groupBy("ring").agg((F.sum(c("x1") * c("y2") - c("x2") * c("y1")) < 0).alias("turned"))
    up = (c("y2") > c("y1")) | ((c("y2") == c("y1")) & (c("x2") > c("x1")))
    pick = lambda a, b: F.when(up, c(a)).otherwise(c(b)).alias(a)
    gain = F.when(up != c("turned"), 1).otherwise(-1).cast("long")
    segments = edges.join(turned, "ring").select(F.lit(0).alias("key"), F.lit(None).cast("long").alias("segment"), pick("x1", "x2"), pick("y1", "y2"), pick("x2", "x1"), pick("y2", "y1"), gain.alias("n0"), F.lit(0).cast("long").alias("n1"))
    segments = cut_lineage(spread(segments))
    places = points.where("x is not null and y is not null").select(F.lit(0).alias("key"), c(point), "x", "y", F.lit(None).cast("long").alias("segment"))
    told = winding(places, segments, point, size or cell_size(segments)).select(point, (c("w0") > 0).alias("inside"))
    return points.select(point).join(told, point, "left").select(point, F.coalesce("inside", F.lit(False)).alias("inside"))


def union(w0: Column, w1: Column) -> Column:
    return (w0 > 0) | (w1 > 0)


def intersection(w0: Column, w1: Column) -> Column:
    return (w0 > 0) & (w1 > 0)


def difference(w0: Column, w1: Column) -> Column:
    return (w0 > 0) & (w1 <= 0)


#: Rules that only ask whether each winding number is positive: with them, cells wholly inside or outside are told beforehand.
RULES = (union, intersection, difference)
#: How much finer than `cell_size` the grid is then: what an edge's cells cost against how near the border cells are still looked into.
FINER = 32


def overlay(edges: DataFrame, inside: Callable[[Column, Column], Column] = union, size: float | None = None, digits: int = 9) -> DataFrame:
    """(key, segment, x1, y1, x2, y2): the boundary of the result, its inside to the left, for each key; cut.

    Edges are (key, layer, x1, y1, x2, y2) with layers 0 and 1, interior to the left;
    `inside` tells from the layers' winding numbers what the result holds.  Polygons
    of one layer may overlap, share borders or lie in one another.
    """
    known = inside in RULES
    size = size or cell_size(edges) / (FINER if known else 1)
    made = pieces(edges, size, digits, inside) if known else pieces(edges, size, digits).withColumn("whole", F.lit(True))
    short = cut_lineage(spread(numbered(made, "key", "x1", "y1", "x2", "y2", name="segment")))
    middles = short.where("whole").select("key", "segment", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")).withColumn("place", F.col("segment"))
    told = short.join(winding(middles, short, "place", size).withColumnRenamed("place", "segment"), ["key", "segment"])
    left = inside(F.col("w0"), F.col("w1"))
    right = inside(F.col("w0") - F.col("n0"), F.col("w1") - F.col("n1"))
    kept = told.where(left != right)
    turn = lambda a, b: F.when(left, F.col(a)).otherwise(F.col(b)).alias(a)
    return cut_lineage(kept.select("key", "segment", turn("x1", "x2"), turn("y1", "y2"), turn("x2", "x1"), turn("y2", "y1")))


def clip_box(edges: DataFrame, box: tuple[float, float, float, float], size: float | None = None, digits: int = 9) -> DataFrame:
    """The polygons (key, x1, y1, x2, y2) within the box (x1, y1, x2, y2), as `overlay` gives them."""
    a, b, c, d = (float(v) for v in box)
    corners = [(a, b), (c, b), (c, d), (a, d)]
    sides = edges.sparkSession.createDataFrame([(*p, *q) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)], "x1 double, y1 double, x2 double, y2 double")
    keys = edges.select("key").distinct()
    both = edges.select("key", F.lit(0).alias("layer"), "x1", "y1", "x2", "y2").unionByName(keys.join(F.broadcast(sides)).select("key", F.lit(1).alias("layer"), "x1", "y1", "x2", "y2"))  # four rows a key
    return overlay(both, intersection, size, digits)


def area(edges: DataFrame) -> DataFrame:
    """(key, area, perimeter) of boundaries with their inside to the left."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edges.groupBy("key").agg((F.sum(cross) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"))


def walked(edges: DataFrame) -> DataFrame:
    """(key, ring, position, x, y, hole): the boundary's rings, walked with the inside to the left.

    At a place where several rings meet, each goes on along the first edge clockwise
    from where it came, which bounds the same part of the inside.  A ring's number is
    that of its least segment; holes run clockwise.
    """
    into = edges.select("key", "segment", F.col("x2").alias("x"), F.col("y2").alias("y"), F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("back"))
    out = edges.select("key", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("segment").alias("next"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("on"))
    turn = F.pmod(F.col("back") - F.col("on"), F.lit(2 * math.pi))
    best = into.join(out, ["key", "x", "y"]).groupBy("segment").agg(F.min_by("next", F.struct(F.when(turn > 0, turn).otherwise(2 * math.pi), "next")).alias("next"))
    placed = ring_positions(best, "segment", "next")
    points = edges.select("key", "segment", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("cross")).join(placed, "segment")
    kind = points.groupBy("ring").agg((F.sum("cross") < 0).alias("hole"))
    return points.join(kind, "ring").select("key", "ring", "position", "x", "y", "hole")
