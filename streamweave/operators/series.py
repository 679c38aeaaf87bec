"""Time-series operators: climatology, completeness, low flow, dry periods, seasons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamweave.functions.scalar import percent_change, shortest_turn


def climatology(monthly: DataFrame, key: str, month: str, value: str, min_months: int = 60) -> DataFrame:
    """Mean, least, greatest, number of months and first and last month per station."""
    return (
        monthly.groupBy(key)
        .agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("n_months"), F.min(month).alias("first_month"), F.max(month).alias("last_month"))
        .where(F.col("n_months") >= min_months)
    )


def regime(monthly: DataFrame, key: str, calendar_month: str, value: str, digits: int = 2) -> DataFrame:
    """Twelve calendar-month means in order, null unless all twelve are there."""
    by_month = monthly.groupBy(key, calendar_month).agg(F.round(F.avg(value), digits).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct(calendar_month, "m")))
    return by_month.groupBy(key).agg(ordered.alias("pairs")).select(key, F.when(F.size("pairs") == 12, F.transform("pairs", lambda p: p["m"])).alias("regime"))


def complete_periods(rows: DataFrame, keys: Sequence[str], aggregate: Column, least: int, exact: bool = False) -> DataFrame:
    """An aggregate per group, kept where the group has enough rows (or exactly so many)."""
    enough = F.col("n") == least if exact else F.col("n") >= least
    return rows.groupBy(*keys).agg(aggregate, F.count("*").alias("n")).where(enough)


def best_version(rows: DataFrame, keys: Sequence[str], level: str, *then: Column) -> DataFrame:
    """The row of the highest level per key; ties by the given total order."""
    order = Window.partitionBy(*keys).orderBy(F.col(level).desc(), *then)
    return rows.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def dedup_with_count(rows: DataFrame, key: Column, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The first row per key by `order`, and how many rows the key had.

    One aggregation with map-side combination: no window and no sort of whole groups.
    """
    first = F.min(F.struct(*order, *[c for c in keep if c not in order]))
    return rows.groupBy(key.alias("key")).agg(first.alias("first"), F.count("*").alias("multiplicity")).select("key", *[F.col(f"first.{c}").alias(c) for c in keep], "multiplicity")


def rolling_mean(daily: DataFrame, key: str, day: str, value: str, rows: int = 7, name: str = "rolling") -> DataFrame:
    """Trailing mean over `rows` rows (not days); the first ones are partial."""
    frame = Window.partitionBy(key).orderBy(day).rowsBetween(1 - rows, 0)
    return daily.withColumn(name, F.avg(value).over(frame))


def low_flow(daily: DataFrame, key: str, day: str, value: str, windows: dict[str, tuple[int, int]], min_days: int = 330, min_years: int = 15, quantile: float = 0.1) -> DataFrame:
    """Quantile and median of annual minima of the 7-row mean, before and after.

    Years need `min_days` rows, windows `min_years` years, and both windows must
    be there.  One shuffle by station serves the rolling mean and the day count.
    """
    year = F.year(day)
    days = F.count("*").over(Window.partitionBy(key, "year"))
    rolled = rolling_mean(daily, key, day, value).withColumn("year", year).withColumn("days", days)
    minima = rolled.where(F.col("days") >= min_days).groupBy(key, "year").agg(F.min("rolling").alias("least"))
    per = minima.withColumn("window", window_of(F.col("year"), windows)).where("window is not null")
    stats = per.groupBy(key, "window").agg(F.percentile("least", quantile).alias("q"), F.median("least").alias("med"), F.count("*").alias("years")).where(F.col("years") >= min_years)
    return both_windows(stats, key, ["q", "med", "years"], list(windows)).withColumns({"change": percent_change(F.col("q_before"), F.col("q_after")), "became_zero": (F.col("q_before") > 0) & (F.col("q_after") <= 0)})


def window_of(year: Column, windows: dict[str, tuple[int, int]]) -> Column:
    """Name of the window that a year falls into, null if none."""
    out = None
    for name, (a, b) in windows.items():
        out = F.when(year.between(a, b), name) if out is None else out.when(year.between(a, b), name)
    return out


def both_windows(rows: DataFrame, key: str, values: Sequence[str], windows: Sequence[str]) -> DataFrame:
    """One row per key that has both windows: each value as `<value>_before` and `<value>_after`."""
    first, second = windows
    one = lambda v, w: F.max(F.when(F.col("window") == w, F.col(v)))
    aggregates = [one(v, w).alias(f"{v}_{suffix}") for v in values for w, suffix in ((first, "before"), (second, "after"))]
    return rows.groupBy(key).agg(*aggregates, F.countDistinct("window").alias("__n")).where("__n = 2").drop("__n")


def circular_mean_month(weights: DataFrame, keys: Sequence[str], month: str, weight: str) -> DataFrame:
    """Weighted mean month on the circle, 1 to 13; null where it isn't defined."""
    angle = (F.col(month) - 1) * F.lit(2 * math.pi / 12)
    sums = weights.groupBy(*keys).agg(F.sum(F.col(weight) * F.cos(angle)).alias("c"), F.sum(F.col(weight) * F.sin(angle)).alias("s"), F.sum(weight).alias("w"))
    turn = F.pmod(F.atan2("s", "c") / F.lit(2 * math.pi) * 12, F.lit(12.0)) + 1
    defined = (F.col("w") > 0) & ((F.col("c") != 0) | (F.col("s") != 0))
    return sums.select(*keys, F.when(defined, turn).alias("mean_month"))


def season_shift(monthly: DataFrame, key: str, year: str, month: str, value: str, windows: dict[str, tuple[int, int]], min_years: int = 15) -> DataFrame:
    """Signed shift of the mean month between two windows (months)."""
    rows = monthly.withColumn("window", window_of(F.col(year), windows)).where("window is not null")
    by_month = rows.groupBy(key, "window", month).agg(F.avg(value).alias("mean"), F.countDistinct(year).alias("years"))
    full = by_month.groupBy(key, "window").agg(F.count("*").alias("months"), F.min("years").alias("years")).where((F.col("months") == 12) & (F.col("years") >= min_years))
    means = circular_mean_month(by_month.join(full.select(key, "window"), [key, "window"], "left_semi"), [key, "window"], month, "mean")
    both = both_windows(means.join(full, [key, "window"]), key, ["mean_month", "years"], list(windows))
    return both.withColumn("shift", shortest_turn(F.col("mean_month_after") - F.col("mean_month_before")))


def dry_panel(daily: DataFrame, key: str, day: str, dry: Column, min_days: int = 300) -> DataFrame:
    """Dry and measured days per year of stations that were ever dry."""
    flagged = daily.withColumn("__dry", dry)
    ever = flagged.where("__dry").select(key).distinct()
    per_year = flagged.join(ever, key, "left_semi").groupBy(key, F.year(day).alias("year")).agg(F.count_if("__dry").alias("dry_days"), F.count("*").alias("days"))
    return per_year.where(F.col("days") >= min_days)


def dry_by_year(panel: DataFrame, key: str) -> DataFrame:
    """Dry days and stations with any, per year."""
    return panel.where("dry_days > 0").groupBy("year").agg(F.sum("dry_days").alias("dry_days"), F.countDistinct(key).alias("stations"))


def presence_matrix(rows: DataFrame, row_key: str, column_key: str, member: str, columns: Sequence[str]) -> DataFrame:
    """Distinct members per row and column as a dense matrix with 0 where there are none."""
    return rows.groupBy(row_key).pivot(column_key, list(columns)).agg(F.countDistinct(member)).na.fill(0)
