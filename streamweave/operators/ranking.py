"""Global ranks, running totals and exact quantiles without one-task windows.

Rows are sorted into ranges once and cut there; each range is numbered in place
and shifted by what stands before it (one number per range), so nothing but
those numbers is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamweave.operators.lineage import cut_lineage


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows in sorted ranges, each row with the number of its `__range`."""
    n = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))


def running_total(rows: DataFrame, weight: Column, *order: Column | str, name: str = "before", total: str | None = None) -> DataFrame:
    """Add the sum of `weight` over all rows that come earlier in `order` (a total order).

    With `total` the overall sum is added too.  `__range` is dropped.
    """
    held = ranged(rows.withColumn("__weight", weight), *order)
    sums = held.groupBy("__range").agg(F.sum("__weight").alias("__sum"))
    ahead = F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    every = F.sum("__sum").over(Window.partitionBy())
    starts = sums.select("__range", F.coalesce(ahead, F.lit(0)).alias("__start"), every.alias("__all"))  # a row per range
    within = F.sum("__weight").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = held.withColumn("__within", F.coalesce(within, F.lit(0))).join(F.broadcast(starts), "__range")
    out = out.withColumn(name, F.col("__within") + F.col("__start"))
    out = out.withColumn(total, F.col("__all")) if total else out
    return out.drop("__weight", "__within", "__start", "__all", "__range")


def numbered(rows: DataFrame, *order: Column | str, name: str = "rank", total: str | None = None) -> DataFrame:
    """Add the row's number from 0 in a total order."""
    return running_total(rows, F.lit(1).cast("long"), *order, name=name, total=total)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str = "q") -> DataFrame:
    """Exact interpolated quantiles per group: (keys, q array in the order of `shares`).

    Equal values are counted first (with map-side combination), so what is sorted
    is distinct values; a group of any size is spread over ranges.  Nulls don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    held = ranged(counts, *keys, "__v")
    sums = held.groupBy(*keys, "__range").agg(F.sum("__c").alias("__s"))  # a row per group and range that it stands in
    by_range = Window.partitionBy(*[F.lit(0), *keys]).orderBy("__range")
    starts = sums.select(*keys, "__range", F.coalesce(F.sum("__s").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__s").over(Window.partitionBy(*[F.lit(0), *keys])).alias("__n"))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = held.alias("h").join(starts.alias("s"), [F.col("h.__range") == F.col("s.__range"), *same]).select(*[F.col(f"h.{k}").alias(k) for k in keys], "h.__range", "h.__v", "h.__c", "s.__start", "s.__n")
    upto = F.sum("__c").over(Window.partitionBy("__range", *keys).orderBy("__v")) + F.col("__start")
    placed = both.withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - F.col("__c"))
    picks = []
    for i, share in enumerate(shares):
        at = (F.col("__n") - 1) * F.lit(float(share))
        for j, rank in enumerate((F.floor(at), F.ceil(at))):
            picks.append(F.max(F.when((rank >= F.col("__lo")) & (rank < F.col("__hi")), F.col("__v"))).alias(f"__q{i}_{j}"))
    got = placed.groupBy(*keys).agg(F.first("__n").alias("__n"), *picks)
    part = lambda s: (F.col("__n") - 1) * F.lit(float(s)) - F.floor((F.col("__n") - 1) * F.lit(float(s)))
    between = [F.col(f"__q{i}_0") + part(s) * (F.col(f"__q{i}_1") - F.col(f"__q{i}_0")) for i, s in enumerate(shares)]
    return got.select(*keys, F.array(*between).alias(name))
