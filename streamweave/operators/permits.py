"""Permit pressure: classification, loads, ceilings and what isn't covered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamweave.operators.forest import accumulate

SECONDS_PER_HOUR = 3600.0


def flow_m3s(per_hour: Column) -> Column:
    """m3/h to m3/s; a missing flow counts as none."""
    return F.coalesce(per_hour.cast("double"), F.lit(0.0)) / SECONDS_PER_HOUR


def classify(rules: list[tuple[Column, str]], other: str) -> Column:
    """The class of the first rule that holds (a null condition doesn't)."""
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return (out.otherwise(other) if out is not None else F.lit(other))


def matches(text: Column, pattern: str) -> Column:
    """Unicode, case-insensitive search."""
    return F.rlike(text, F.lit(f"(?iU){pattern}"))


def load_by_class(permits: DataFrame, node: str, class_column: str, load: Column) -> DataFrame:
    return permits.groupBy(node, class_column).agg(F.sum(load).alias("load"), F.count("*").alias("n"))


def over_ceiling(loads: DataFrame, ceilings: DataFrame, captured: DataFrame, key: str, factor: float = 3.0, least: float = 0.05, share: float = 0.3) -> DataFrame:
    """Keys whose load passes max(factor * ceiling, least) and whose capture is at least `share` of it.

    Both conditions are needed; a key without a ceiling is skipped.
    """
    rows = loads.join(ceilings, key).join(captured, key, "left")
    taken = F.coalesce("captured", F.lit(0.0))
    return rows.where((F.col("load") > F.greatest(F.col("ceiling") * factor, F.lit(least))) & (taken >= F.col("load") * share))


def relabel(permits: DataFrame, suspects: DataFrame, key: str, class_column: str, old: str, new: str) -> DataFrame:
    flagged = permits.join(suspects.select(key, F.lit(True).alias("__suspect")), key, "left")
    return flagged.withColumn(class_column, F.when((F.col(class_column) == old) & F.col("__suspect"), new).otherwise(F.col(class_column))).drop("__suspect")


def share_of_flow(load: Column, flow: Column, ceiling: float) -> Column:
    """Load over flow (at least 1e-6), clipped to [0, ceiling]."""
    return F.least(F.greatest(load / F.greatest(flow, F.lit(1e-6)), F.lit(0.0)), F.lit(float(ceiling)))


def accumulated_share(nodes: DataFrame, node: str, down: str, loads: Sequence[str], flow: str, ceiling: float = 1.0) -> DataFrame:
    """(node, a share per load): what has gathered from upstream over the reach's flow, clipped."""
    totals = accumulate(nodes, node, down, loads)
    flows = nodes.select(node, F.col(flow).alias("__flow"))
    return totals.join(flows, node).select(node, *[share_of_flow(F.col(c), F.col("__flow"), ceiling).alias(c) for c in loads])


def uncovered(need: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys that need cover and have none."""
    return need.join(have, key, "left_anti")
