"""Guards between versions of a table, match counters, and client-side queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamweave.functions.scalar import without_accents


def mismatches(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Keys that one version lacks or that differ in the value."""
    left, right = a.select(key, F.col(value).alias("left_value")), b.select(key, F.col(value).alias("right_value"))
    both = left.join(right, key, "full_outer")
    differs = F.col("left_value").isNull() | F.col("right_value").isNull() | (F.abs(F.col("left_value") - F.col("right_value")) > tolerance)
    return both.where(differs)


def assert_same(a: DataFrame, b: DataFrame, key: str, value: str) -> None:
    """Abort if the versions aren't the same rows."""
    if mismatches(a, b, key, value).limit(1).count():
        raise ValueError(f"{key}/{value}: the two versions don't match")


def match_quality(matched: DataFrame, found: Column, agrees: Column) -> DataFrame:
    """Matched, orphans, and of the matched those that agree."""
    return matched.agg(F.count_if(found).alias("matched"), F.count_if(~found).alias("orphans"), F.count_if(found & agrees).alias("agrees"))


def search_names(names: DataFrame, name: str, wanted: str, least: int = 2) -> DataFrame:
    """Rows whose name holds the words, without regard to case or accents."""
    if len(wanted.strip()) < least:
        return names.limit(0)
    key = F.lower(without_accents(F.col(name)))
    return names.where(F.contains(key, F.lower(without_accents(F.lit(wanted.strip())))))


def search_rivers(reaches: DataFrame, river: str, name: str, flow: str, state: str, wanted: str, least: int = 2) -> DataFrame:
    """(river, name, flow, states): a hit per river id, the largest flow first.

    Rivers of one name stay apart.  `states` joins the two states (in their
    order) that most of the river's reaches lie in; reaches outside all states
    have none, and a river of such reaches only has an empty label.
    """
    hits = search_names(reaches.where(F.col(name).isNotNull()), name, wanted, least)
    found = hits.groupBy(river).agg(F.min(name).alias("name"), F.max(flow).alias("flow"))
    per = hits.where(F.col(state).isNotNull()).groupBy(river, state).agg(F.count("*").alias("__n"))
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col(state).alias("s")))), 1, 2)  # states per river: a fixed few
    label = per.groupBy(river).agg(F.array_join(F.array_sort(F.transform(top, lambda t: t["s"])), "/").alias("states"))
    return found.join(label, river, "left").select(F.col(river).alias("river"), "name", "flow", F.coalesce("states", F.lit("")).alias("states"))


def count_gap(rows: DataFrame, expected: int) -> int:
    """Expected rows less the ones received: 0 if a download is complete."""
    return expected - rows.count()


def log_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Class of a value on a logarithmic scale, 0 to bins - 1; null where it isn't positive."""
    lo = F.log10(F.lit(low))
    position = (F.log10(value) - lo) / (F.log10(F.lit(high)) - lo) * bins
    return F.when(value > 0, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(position)))).cast("long")


def half_open_bin(value: Column, edges: list[float]) -> Column:
    """Index of the class (lo, hi] that the value falls into; null outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        hit = (value > lo) & (value <= hi)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.cast("long")
