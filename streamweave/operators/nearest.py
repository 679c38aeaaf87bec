"""The nearest neighbours by two trees of cells that follow the density of stations and points.

Cells that hold more than LEAF stations are split eight by eight, each within the box
that its own stations span, so a cluster and a far outlier alike end in cells of few
stations after a few levels.  Points are put into tiles in the same way, and the
tiles go down the stations' tree together, a level at a time: the cells that a tile still
has to look into are joined with their parts, and those are dropped that lie further
away from all of its box than cells nearer by which hold enough stations for certain.  So
what is shuffled is a row for a tile and cell, not for a point and cell.  In the end each tile
meets the stations of a few leaves, and each of its points those of the leaves near it.
Where stations lie so thick that a tile would meet many, it is cut finer, down to single points.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamweave.functions.shipping import ship_package
from streamweave.operators.lineage import Tables

#: Stations of a cell that isn't split further; parts of a cell along each axis; levels at most (what is left then is a leaf, however many).
LEAF, PARTS, LEVELS = 64, 8, 9
#: Points of a tile that isn't split further, coarsest first; parts along each axis; levels at most; stations that a tile may meet unless it can't be cut finer.
TILES, TILE_PARTS, TILE_LEVELS, MEETS = (256, 16, 1), 4, 13, 4096


def _tree(tables: Tables, items: DataFrame, x: str, y: str, most: int, parts: int, deepest: int) -> tuple[list[DataFrame], DataFrame]:
    """(each level's cells with what they hold, the items with the leaf `cell` that they end in) of items with a kind `__of`."""
    c = F.col
    placed = tables.write(items.withColumn("cell", F.lit(1).cast("long")))
    levels, ends = [], []
    for level in range(deepest + 1):
        kinds = placed.groupBy("cell", "__of").agg(F.count("*").alias("n"), F.min(x).alias("x1"), F.max(x).alias("x2"), F.min(y).alias("y1"), F.max(y).alias("y2"))
        held = kinds.groupBy("cell").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("__of", "n"))).alias("kinds"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))
        one_place = (c("x1") == c("x2")) & (c("y1") == c("y2"))
        cells = tables.write(held.withColumn("leaf", (c("n") <= most) | one_place | F.lit(level == deepest)))
        levels.append(cells)
        ends.append(placed.join(cells.where("leaf").select("cell", c("n").alias("__n"), one_place.alias("__one")), "cell"))
        inner = cells.where("not leaf").select("cell", "x1", "x2", "y1", "y2")
        if not inner.limit(1).count():
            break
        part = lambda v, low, high: F.coalesce(F.least(F.lit(parts - 1), F.floor(F.try_divide(c(v) - c(low), c(high) - c(low)) * parts)), F.lit(0)).cast("long")
        below = c("cell") * parts**2 + part(x, "x1", "x2") * parts + part(y, "y1", "y2")
        placed = tables.write(placed.join(inner, "cell").select(*items.columns, below.alias("cell")))
    return levels, reduce(DataFrame.unionByName, ends)


def of_tile(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, starts: np.ndarray, rank: np.ndarray, counted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(point, station, distance, nth for each choice (0: not among its k), pairs met) of a tile's points.

    Stations come leaf by leaf, each leaf from its place in `starts`; `rank` orders them at
    equal distances, `counted` tells for each choice which of them count.
    """
    sizes = np.diff(np.append(starts, len(sx)))
    span = lambda p, v: (p[:, None], np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts))
    (px, x1, x2), (py, y1, y2) = span(x, sx), span(y, sy)
    near = np.hypot(np.maximum(np.maximum(x1 - px, px - x2), 0.0), np.maximum(np.maximum(y1 - py, py - y2), 0.0))
    far = np.hypot(np.maximum(abs(px - x1), abs(px - x2)), np.maximum(abs(py - y1), abs(py - y2)))
    by_far = far.argsort(axis=1)
    wanted = np.zeros(near.shape, bool)
    for n in np.add.reduceat(counted.astype(np.int64), starts, axis=1):
        enough = n[by_far].cumsum(axis=1) >= k
        sure = np.take_along_axis(far, np.take_along_axis(by_far, enough.argmax(axis=1)[:, None], axis=1), axis=1)
        wanted |= (n > 0) & (near <= np.where(enough[:, -1:], sure, np.inf) * (1 + 1e-12))
    point, leaf = wanted.nonzero()
    each = sizes[leaf]
    station = np.repeat(starts[leaf] - (each.cumsum() - each), each) + np.arange(each.sum())
    point = np.repeat(point, each)
    ex, ey = x[point] - sx[station], y[point] - sy[station]
    distance = np.sqrt(ex * ex + ey * ey)
    order = np.lexsort((rank[station], distance, point))
    point, station, distance = point[order], station[order], distance[order]
    counts = counted[:, station]
    upto = np.pad(counts.cumsum(axis=1), ((0, 0), (1, 0)))
    nth = upto[:, 1:] - upto[:, np.searchsorted(point, point)]
    nth[~counts | (nth > k)] = 0
    kept = nth.any(axis=0)
    return point[kept], station[kept], distance[kept], nth[:, kept], len(point)


def nearest_k(points: DataFrame, stations: DataFrame, point: str, station: str, k: int, apart: tuple[str, str] | None = None, met: list[int] | None = None, without: tuple[str, list] | None = None) -> DataFrame:
    """The k nearest stations of each point by planar distance, ties by id: adds `distance` and `nth`.

    Stations have (sx, sy), points (x, y).  With `apart` (a column of the points and
    one of the stations, of few values) only stations of another value count.  With
    `without` (a column of the stations and some of its values) the k nearest are found
    for each value among the stations that don't have it, all in one search: `nth_0`,
    `nth_1`, ... in place of `nth`, null where a station isn't among them.
    Points must be unique; points and stations without a place are left out.  The
    number of pairs whose distance is taken is appended to `met`.
    """
    columns = [*points.columns, *stations.columns]
    left_out = [None if v is None else str(v) for v in without[1]] if without else []
    nths = [f"nth_{i}" for i in range(len(left_out))] if without else ["nth"]
    stations = stations.where("sx is not null and sy is not null")
    if not stations.limit(1).count():
        return points.join(stations.limit(0), F.lit(True)).select(*columns, F.lit(0.0).alias("distance"), *[F.lit(0).alias(n) for n in nths])
    c = F.col
    ship_package(points.sparkSession)
    tables = Tables(points.sparkSession)
    theirs = c(apart[1]).cast("string") if apart else F.coalesce(c(without[0]).cast("string"), F.lit("")) if without else F.lit("")
    levels, ends = _tree(tables, stations.withColumn("__of", theirs), "sx", "sy", LEAF, PARTS, LEVELS)
    # Of many stations at one place the first k of a kind are enough.
    first = F.row_number().over(Window.partitionBy("cell", "__of").orderBy(station))
    many = c("__one") & (c("__n") > LEAF)
    few = ends.where(many).withColumn("__first", first).where(c("__first") <= k).drop("__first")
    stops = ends.where(~many).unionByName(few).drop("__n", "__one")
    ours = F.col(apart[0]).cast("string") if apart else F.lit("-")
    asked = points.where("x is not null and y is not null").withColumn("__of", ours).where("__of is not null")
    tile = ["__tile", "__part", "__kind"]
    kinds_out = [F.lit(v) for v in left_out] if without else [c("__kind")]
    wide_x, wide_y = F.greatest(c("x1") - c("tx2"), c("tx1") - c("x2"), F.lit(0.0)), F.greatest(c("y1") - c("ty2"), c("ty1") - c("y2"), F.lit(0.0))
    far_x, far_y = F.greatest(c("tx2") - c("x1"), c("x2") - c("tx1")), F.greatest(c("ty2") - c("y1"), c("y2") - c("ty1"))
    names = [*tile, "tx1", "tx2", "ty1", "ty2", "cell", "n", "leaf", "near", "far", *[f"counts_{i}" for i in range(len(nths))]]
    schema = asked.drop("__of").join(stations.limit(0), F.lit(True)).select(*columns, F.lit(0.0).alias("distance"), *[F.lit(0).alias(n) for n in nths], F.lit(0).cast("long").alias("__met")).schema
    for f in schema:
        f.nullable = True
    grouped = bool(apart)

    def look(key: tuple, mine: pa.Table, other: pa.Table) -> pa.Table:
        from streamweave.operators.nearest import of_tile

        other = other.sort_by([("__leaf", "ascending")]) if mine.num_rows else other.slice(0, 0)
        if not other.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=schema.names)
        leaf = other["__leaf"].to_numpy()
        at = lambda t, n: t[n].cast(pa.float64()).to_numpy()
        of = np.array(other["__of"].to_pylist(), object)
        counted = np.array([of != v if v is not None else np.zeros(len(of), bool) for v in ([key[2].as_py()] if grouped else left_out or ["-"])])
        rank = np.empty(len(of), np.int64)
        rank[pc.sort_indices(other[station].combine_chunks()).to_numpy()] = np.arange(len(of))
        p, s, distance, nth, pairs = of_tile(at(mine, "x"), at(mine, "y"), at(other, "sx"), at(other, "sy"), np.append(0, np.flatnonzero(np.diff(leaf)) + 1), rank, counted, k)
        met_here = np.zeros(len(p), np.int64)
        met_here[:1] = pairs
        held = [t[n].take(pa.array(i)) for t, i, ns in ((mine, p, ours_), (other, s, theirs_)) for n in ns]
        return pa.table([*held, pa.array(distance), *[pa.array(n.astype(np.int32), mask=n == 0) for n in nth], pa.array(met_here)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds, ours_, theirs_ = [to_arrow_type(f.dataType) for f in schema], points.columns, stations.columns
    found = []
    for most in TILES:
        _, placed = _tree(tables, asked, "x", "y", most, TILE_PARTS, TILE_LEVELS)
        part = F.pmod(F.xxhash64(point), F.ceil(c("__n") / TILES[0]))  # many at one place are dealt out
        placed = placed.withColumns({"__part": part, "__kind": c("__of")}).withColumnRenamed("cell", "__tile").drop("__n", "__one")
        boxes = placed.groupBy(*tile).agg(F.min("x").cast("double").alias("tx1"), F.max("x").cast("double").alias("tx2"), F.min("y").cast("double").alias("ty1"), F.max("y").cast("double").alias("ty2"))
        # What each tile looks into: cells of this level, and leaves of those above.
        front, leaves = tables.write(boxes.withColumn("cell", F.lit(0).cast("long"))), None
        for cells in levels:
            up = cells.withColumn("up", F.shiftright("cell", 6)).withColumnRenamed("cell", "own")
            into = front.withColumnRenamed("cell", "up").join(up, "up").withColumnRenamed("own", "cell")
            counts = {f"counts_{i}": c("n") - F.coalesce(F.try_element_at("kinds", kind), F.lit(0)) for i, kind in enumerate(kinds_out)}
            into = into.withColumns({"near": F.hypot(wide_x, wide_y), "far": F.hypot(far_x, far_y), **counts}).where(" or ".join(f"{n} > 0" for n in counts)).select(*names)
            every = into if leaves is None else into.unionByName(leaves)
            # The distance within which k stations lie for certain: cells by their furthest corner.
            by_far = Window.partitionBy(*tile).orderBy("far", "cell")
            enough = every.withColumns({f"__sure_{i}": F.when(F.sum(n).over(by_far) >= k, c("far")) for i, n in enumerate(counts)})
            enough = enough.withColumns({f"__bound_{i}": F.min(f"__sure_{i}").over(Window.partitionBy(*tile)) for i in range(len(counts))})
            wanted = [(c(n) > 0) & (c(f"__bound_{i}").isNull() | (c("near") <= c(f"__bound_{i}") * (1 + 1e-12))) for i, n in enumerate(counts)]
            kept = tables.write(enough.where(reduce(Column.__or__, wanted)).select(*names))
            leaves, front = kept.where("leaf"), kept.where("not leaf").select(*tile, "tx1", "tx2", "ty1", "ty2", "cell")
        wide = leaves.groupBy(*tile).agg(F.sum("n").alias("n")).where(c("n") > MEETS).select(*tile) if most > 1 else None
        wide = tables.write(wide) if most > 1 else None
        some = most > 1 and wide.limit(1).count() > 0
        near = leaves.select(*tile, "cell")
        mine, near = (placed.join(wide, tile, "left_anti"), near.join(wide, tile, "left_anti")) if some else (placed, near)
        meets = near.join(stops, "cell").withColumnRenamed("cell", "__leaf").select(*tile, "__leaf", "__of", *theirs_)
        found.append(tables.write(mine.select(*tile, *ours_).groupBy(*tile).cogroup(meets.groupBy(*tile)).applyInArrow(look, schema)))
        if not some:
            break
        asked = tables.write(placed.join(wide, tile, "left_semi").drop(*tile))
    got = reduce(DataFrame.unionByName, found)
    if met is not None:
        met.append(got.agg(F.coalesce(F.sum("__met"), F.lit(0))).first()[0])
    spare = [t for t in tables.paths.values() if t is not None and not any(t is f for f in found)]
    tables.drop(*spare)
    return got.drop("__met")
