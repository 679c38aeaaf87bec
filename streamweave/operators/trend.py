"""Non-parametric trends: Mann-Kendall, Theil-Sen, false discovery rate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamweave.functions.scalar import erfc
from streamweave.functions.shipping import ship_package
from streamweave.operators.ranking import numbered, ranged


def gathered(series: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row per series: its points in order, and n, first, last and mean.

    Series are annual (some hundred points at most), so a row holds one; a single
    shuffle by station replaces the self-join of every two points.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).cast("double").alias("y"))))
    rows = series.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(key).agg(points.alias("points"), F.count("*").alias("n"), F.min(x).alias("first"), F.max(x).alias("last"), F.avg(y).alias("mean"))


def pair_differences(points: Column) -> Column:
    """Array of (dx, dy) of every two points, the later minus the earlier."""
    later = lambda i: F.slice(points, i + 2, F.size(points))
    one = lambda a, i: F.transform(later(i), lambda b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))
    return F.filter(F.flatten(F.transform(points, one)), lambda p: p["dx"] > 0)


def pairs(series: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, dx, dy) of every two points of one series."""
    return gathered(series, key, x, y).select(key, F.explode(pair_differences(F.col("points"))).alias("p")).select(key, "p.dx", "p.dy")


#: Points of a series whose pairs are all held at once; those of longer ones are counted, and seen block by block.
ALL_PAIRS = 512


def falling_pairs(z: np.ndarray) -> int:
    """Pairs of which the later is smaller, counted while blocks are merged: n log n, no pair is held."""
    n, base = len(z), 64
    whole = n // base * base
    held = z[:whole].reshape(-1, base)
    upper = np.triu(np.ones((base, base), bool), 1)
    total = sum(int(((part[:, None, :] < part[:, :, None]) & upper).sum()) for part in np.array_split(held, max(1, len(held) // 1024)))
    rest = z[whole:]
    total += int((np.triu(np.ones((len(rest), len(rest)), bool), 1) & (rest[None, :] < rest[:, None])).sum())
    blocks = [np.sort(b) for b in held] + ([np.sort(rest)] if len(rest) else [])
    while len(blocks) > 1:
        merged = []
        for left, right in zip(blocks[::2], blocks[1::2], strict=False):
            total += int(np.searchsorted(right, left, "left").sum())
            merged.append(np.sort(np.concatenate([left, right]), kind="stable"))
        blocks = merged + blocks[len(merged) * 2 :]
    return total


def _ties(*columns: np.ndarray) -> int:
    """Pairs that are alike in all the columns."""
    counts = np.unique(np.stack(columns), axis=1, return_counts=True)[1].astype(object)
    return int((counts * (counts - 1) // 2).sum())


def kendall_s(x: np.ndarray, y: np.ndarray) -> int:
    """Rising less falling pairs among those of different x."""
    n = len(x)
    if n < 2:
        return 0
    order = np.lexsort((y, x))  # within one x nothing falls
    pairs = n * (n - 1) // 2 - _ties(x)
    level = _ties(y) - _ties(x, y)
    return pairs - level - 2 * falling_pairs(y[order])


def sen_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """Median of the slopes of all pairs of different x; none without such a pair.

    Beyond ALL_PAIRS points the median is closed in by halving: with y - m x in
    place of y a pair falls if its slope is below m, so falling pairs tell a slope's rank.
    Then one pass over the pairs, a block of rows at a time, takes out the few slopes that are left.
    """
    order = np.lexsort((y, x))
    x, y = x[order].astype(float), y[order].astype(float)
    n = len(x)
    pairs = n * (n - 1) // 2 - _ties(x) if n else 0
    if not pairs:
        return None
    if n <= ALL_PAIRS:
        i, j = np.triu_indices(n, 1)
        apart = x[j] > x[i]
        found = np.sort((y[j] - y[i])[apart] / (x[j] - x[i])[apart])
        return float((found[(pairs - 1) // 2] + found[pairs // 2]) / 2)
    steps = np.diff(x)
    most = float((y.max() - y.min()) / steps[steps > 0].min()) * 1.001 + 1e-300
    wanted = ((pairs - 1) // 2, pairs // 2)
    low, high, below, upto = -most, most, 0, pairs
    while upto - below > 8 * n:
        middle = (low + high) / 2
        if not low < middle < high or high - low < 1e-13 * max(abs(low), abs(high)):
            break
        rank = falling_pairs(y - middle * x)
        if rank <= wanted[0]:
            low, below = middle, rank
        elif rank > wanted[1]:
            high, upto = middle, rank
        else:
            break  # the two middle slopes lie on either side
    while True:
        room = 1e-11 * (np.abs(y).max() + max(abs(low), abs(high)) * np.abs(x).max()) + 1e-300
        at_low, at_high, under = y - low * x, y - high * x, 0
        kept: dict[float, int] = {}
        for a in range(0, n, 256):
            rows = slice(a, min(n, a + 256))
            later = (np.arange(n)[None, :] > np.arange(rows.start, rows.stop)[:, None]) & (x[None, :] > x[rows, None])
            short = at_low[None, :] < at_low[rows, None] - room
            under += int((later & short).sum())
            i, j = np.nonzero(later & ~short & (at_high[None, :] <= at_high[rows, None] + room))
            values, counts = np.unique((y[j] - y[rows][i]) / (x[j] - x[rows][i]), return_counts=True)
            for v, c in zip(values.tolist(), counts.tolist(), strict=True):
                kept[v] = kept.get(v, 0) + c
        found = sorted(kept)
        ends = np.cumsum([kept[v] for v in found]) if found else np.zeros(0, np.int64)
        if found and under <= wanted[0] and wanted[1] < under + ends[-1]:
            one, two = (found[int(np.searchsorted(ends, k - under, "right"))] for k in wanted)
            return float((one + two) / 2)
        low, high = low - 1e-6 * (most + abs(low)), high + 1e-6 * (most + abs(high))


def tests(rows: DataFrame) -> DataFrame:
    """Add s, z and slope to gathered series."""
    ship_package(rows.sparkSession)
    kind = pa.struct([("s", pa.float64()), ("slope", pa.float64())])

    @F.arrow_udf("struct<s:double,slope:double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from streamweave.operators.trend import kendall_s, sen_slope

        for series in batches:
            flat, ends = series.flatten(), np.cumsum(np.asarray(series.value_lengths()))[:-1]
            xs, ys = (np.split(np.asarray(flat.field(f), float), ends) for f in ("x", "y"))
            yield pa.array([{"s": float(kendall_s(x, y)), "slope": sen_slope(x, y)} for x, y in zip(xs, ys, strict=True)] if len(series) else [], kind)

    ys = F.transform("points", lambda p: p["y"])
    # Equal values are neighbours in order; a run of t of them takes t (t - 1) (2 t + 5) off the variance.
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("sum"))
    off = lambda t: t * (t - 1) * (2 * t + 5)
    step = lambda a, v: F.when(a["v"] == v, F.struct(v.alias("v"), (a["t"] + 1).alias("t"), a["sum"].alias("sum"))).otherwise(F.struct(v.alias("v"), F.lit(1).cast("long").alias("t"), (a["sum"] + off(a["t"])).alias("sum")))
    tied = F.aggregate(F.array_sort(ys), start, step, lambda a: a["sum"] + off(a["t"]))
    rows = rows.withColumn("__m", measured("points")).withColumn("__tied", tied)
    rows = rows.withColumn("s", F.col("__m.s")).withColumn("slope", F.col("__m.slope"))
    rows = rows.withColumn("__var", F.expr("(n * (n - 1) * (2 * n + 5) - __tied) / 18.0D"))
    z = F.when((F.col("__var") > 0) & (F.col("s") != 0), (F.col("s") - F.signum("s")) / F.sqrt("__var")).otherwise(F.lit(0.0))
    return rows.withColumn("z", z).drop("__m", "__tied", "__var")


def mann_kendall_sen(series: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, s, z, slope): Mann-Kendall with tie correction, and Sen's slope.

    Without variance z is 0; a single point has no slope.
    """
    return tests(gathered(series, key, x, y)).select(key, "n", "s", "z", "slope")


def p_value(z: Column) -> Column:
    """Two-sided p of a standard normal z."""
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def benjamini_hochberg(rows: DataFrame, p: str, key: str, name: str = "q") -> DataFrame:
    """Add rank (from 1, ties by key) and the false-discovery q of each p.

    q is the least p * m / rank of this and all later ranks: within a range of
    the sorted rows by a window, beyond it from the later ranges' own least (a
    row per range), so no task holds them all.
    """
    placed = numbered(rows, p, key, name="__at", total="__m").withColumn("rank", F.col("__at") + 1)
    held = ranged(placed.withColumn("__raw", F.col(p) * F.col("__m") / F.col("rank")), "rank")
    later = held.groupBy("__range").agg(F.min("__raw").alias("__least"))
    beyond = F.min("__least").over(Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1))
    ends = later.select("__range", beyond.alias("__beyond"))
    here = F.min("__raw").over(Window.partitionBy("__range").orderBy(F.col("rank").desc()))
    got = held.withColumn("__here", here).join(F.broadcast(ends), "__range")
    least = F.least(F.col("__here"), F.coalesce("__beyond", F.col("__here")))
    return got.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), least))).drop("__at", "__m", "__raw", "__range", "__here", "__beyond")


def trend_records(annual: DataFrame, key: str, year: str, value: str, min_years: int = 20, last_year: int = 2015) -> DataFrame:
    """Eligible series with z, slope and percent of the mean per decade."""
    rows = gathered(annual, key, year, value).withColumn("years", F.col("n"))
    eligible = rows.where((F.col("years") >= min_years) & (F.col("last") >= last_year) & (F.col("mean") > 0))
    return tests(eligible).drop("points").withColumn("pct_decade", F.col("slope") * 10 / F.col("mean") * 100)


def reject_reason(years: Column, last: Column, known: Column, mean: Column, min_years: int, last_year: int) -> Column:
    """Why a series isn't eligible, in the order of the checks; null if it is."""
    return F.when(years < min_years, "short").when(last < last_year, "ended").when(~known, "unknown").when(~(mean > 0), "no flow")


def rain_means(near: DataFrame, rain: DataFrame, span: DataFrame, site: str, gauge: str, year: str, value: str, min_years: int = 25) -> DataFrame:
    """(site, year, gauges, value): the yearly mean of a site's gauges.

    `near` pairs sites with gauges; gauges need `min_years` measured years.  A
    year counts where at least half of the site's gauges (and one) measured, and
    only within the site's own span (site, first, last).
    """
    eligible = rain.where(F.col(value).isNotNull()).groupBy(gauge).agg(F.count("*").alias("__years")).where(F.col("__years") >= min_years)
    near = near.select(site, gauge).join(eligible, gauge, "left_semi")
    of_site = near.groupBy(site).agg(F.count("*").alias("__k"))
    yearly = near.join(rain, gauge).where(F.col(value).isNotNull()).groupBy(site, year).agg(F.count("*").alias("gauges"), F.avg(value).alias(value))
    both = yearly.join(of_site, site).where(F.col("gauges") >= F.greatest(F.lit(1), F.floor(F.col("__k") / 2)))
    return both.join(span, site).where(F.col(year).between(F.col("first"), F.col("last"))).select(site, year, "gauges", value)


def rain_trend(means: DataFrame, site: str, year: str, value: str, min_years: int = 25) -> DataFrame:
    """Mann-Kendall and Sen of each site's rain over its paired years: z, p, percent per decade."""
    rows = gathered(means, site, year, value).where((F.col("n") >= min_years) & (F.col("mean") > 0))
    return tests(rows).select(site, "n", "mean", "z", p_value(F.col("z")).alias("p"), (F.col("slope") * 10 / F.col("mean") * 100).alias("pct_decade"))
