"""Regionalisation: specific discharge, interpolation and its cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamweave.operators.forest import accumulate_anchored_each
from streamweave.operators.lineage import cut_lineage
from streamweave.operators.nearest import nearest_k
from streamweave.operators.ranking import quantiles
from streamweave.operators.spatial import idw_geometric, idw_geometric_each


def specific_discharge(flow: Column, area: Column) -> Column:
    return flow * 1000 / area


def interpolate(points: DataFrame, stations: DataFrame, point: str, station: str, value: str, k: int = 8) -> DataFrame:
    near = nearest_k(points, stations.select(station, "sx", "sy", value), point, station, k)
    return idw_geometric(near, [point], "distance", value)


def cross_validate(stations: DataFrame, station: str, value: str, folds: int = 5, k: int = 8) -> DataFrame:
    """(station, observed, estimate): each station estimated from the other folds.

    Folds are the station's id modulo `folds`, and all run in one plan: a pair is
    allowed if its two ends are of different folds.
    """
    fold = F.pmod(F.col(station), F.lit(folds))
    held = stations.select(F.col(station).alias("held"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col(value).alias("observed"), fold.alias("out"))
    near = nearest_k(held, stations.select(station, "sx", "sy", value, fold.alias("fold")), "held", station, k, apart=("out", "fold"))
    return idw_geometric(near, ["held", "observed"], "distance", value).withColumnRenamed("held", station)


def _estimated(reaches: DataFrame, stations: DataFrame, node: str, down: str, station: str, k: int, fold: str | None) -> DataFrame:
    """(node, flows): an entry (fold, q) for each fold; one of fold null without folds.

    The network is gone through once: neighbours are found for all folds in one search,
    and a reach carries a value per fold, of which only those stop before an
    observation that the fold may see.
    """
    spots = reaches.select(F.col(node).alias("node"), F.col(down).alias("down"), "x", "y", "own_area")
    posts = stations.select(F.col(station).alias("station"), F.col(node).alias("at"), "sx", "sy", "specific", "q", F.col(fold).alias("fold") if fold else F.lit(None).cast("int").alias("fold"))
    folds = [r[0] for r in posts.where("fold is not null").select("fold").distinct().orderBy("fold").collect()] if fold else [None]  # a handful
    kind = dict(posts.dtypes)["fold"]
    if not folds:
        return spots.select("node", F.array().cast(f"array<struct<fold:{kind},q:double>>").alias("flows")).limit(0)
    # Reaches at one place have the same neighbours: each place is searched for once.
    places = cut_lineage(spots.where("x is not null and y is not null").select("x", "y").distinct().withColumn("place", F.monotonically_increasing_id()))
    near = nearest_k(places, posts.select("station", "sx", "sy", "specific", "fold"), "place", "station", k, without=("fold", ["" if f is None else f for f in folds]) if fold else None)
    nth = [f"nth_{i}" for i in range(len(folds))] if fold else ["nth"]
    specific = idw_geometric_each(near, ["place"], "distance", "specific", {f"specific_{i}": F.col(n).isNotNull() for i, n in enumerate(nth)})
    seen = posts.select(F.col("at").alias("node"), F.col("q").alias("observed"), "fold")
    told = spots.join(places.join(specific, "place").drop("place"), ["x", "y"], "left").join(seen, "node", "left")
    local = lambda i: F.coalesce(f"specific_{i}", F.lit(0.0)) * F.col("own_area") / 1000
    holds = lambda f: F.coalesce(F.col("fold") != F.lit(f), F.lit(True))
    cases = {f"q_{i}": (local(i), holds(f)) for i, f in enumerate(folds)}
    totals = accumulate_anchored_each(told, "node", "down", cases, "observed")
    entries = [F.struct(F.lit(f).cast(kind).alias("fold"), F.col(f"q_{i}").alias("q")) for i, f in enumerate(folds)]
    return totals.select("node", F.array(*entries).alias("flows"))


def estimate_network(reaches: DataFrame, stations: DataFrame, node: str, down: str, station: str, k: int = 8, fold: str | None = None) -> DataFrame:
    """(node, q): flow of every reach, interpolated, accumulated and held to the stations.

    `reaches` have (node, down, x, y, own_area), `stations` (station, node, sx, sy,
    specific, q), at most one for a reach.  Each reach takes the specific discharge of its k nearest
    stations times its own area; flows add up downstream, and at a station's reach
    the observation replaces what arrives and flows on.  With `fold` (a column of
    stations) the network is estimated for each fold without its stations, in one
    pass: the result has a row per fold and node.  Stations without a fold are in all.
    """
    flows = _estimated(reaches, stations, node, down, station, k, fold).select(F.col("node").alias(node), F.inline("flows"))
    return flows.select("fold", node, "q") if fold else flows.select(node, "q")


def validate_network(reaches: DataFrame, stations: DataFrame, node: str, down: str, station: str, fold: str, k: int = 8) -> DataFrame:
    """(station, fold, observed, estimate): the network without a station's fold, at its reach."""
    flows = _estimated(reaches, stations, node, down, station, k, fold).withColumnRenamed("node", node)
    held = stations.where(F.col(fold).isNotNull()).select(F.col(station), F.col(fold).alias("fold"), F.col(node), F.col("q").alias("observed"))
    own = F.get(F.filter("flows", lambda f: f["fold"] == F.col("fold")), F.lit(0))["q"]
    return held.join(flows, node).select(station, "fold", "observed", own.alias("estimate"))


def validation_report(estimates: DataFrame, observed: str = "observed", estimate: str = "estimate") -> DataFrame:
    """n, % within 2x and 1.5x, and the median bias; only where both are positive."""
    ratio = F.col(estimate) / F.col(observed)
    rows = estimates.where((F.col(observed) > 0) & (F.col(estimate) > 0)).select(ratio.alias("r"))
    within = lambda f: F.avg(F.when(F.col("r").between(1 / f, f), 100.0).otherwise(0.0))
    shares = rows.agg(F.count("*").alias("n"), within(2.0).alias("within_2x"), within(1.5).alias("within_15x"))
    middle = quantiles(rows.select(F.lit(0).alias("one"), F.log10("r").alias("lr")), ["one"], "lr", [0.5])
    bias = middle.agg(F.pow(F.lit(10.0), F.max(F.col("q")[0])).alias("bias"))
    return shares.join(F.broadcast(bias), F.lit(True))  # two rows of one
