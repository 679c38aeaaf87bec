"""Queries that write what they derive from the tables and read it back: documents in splits, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from streamweave.operators.lineage import shared_folder
from streamweave.plans.inputs import SEGMENTS, segments
from streamweave.sources import geojson, sinks
from streamweave.sources.tables import table
from streamweave.streaming import memory

Q, SQL = {}, {}


def query(sql):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {SEGMENTS} SELECT line, x1, y1, x2, y2 FROM segments")
def geojson_in_splits(spark, d):
    """Lines written as GeoJSON documents and read back wherever the splits fall."""
    lines = segments(spark, d).select("line", F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("coordinates"))
    path = _scratch(spark, "features")
    sinks.geojson_collections(lines, path, "coordinates")
    at = lambda i, j: F.col("coordinates")[i][j]
    return geojson.features(spark, path, "line: long").select("line", at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(1, 0).alias("x2"), at(1, 1).alias("y2"))


@query("""SELECT code, month, level, mean, low FROM (SELECT *, row_number() OVER (PARTITION BY code, month ORDER BY level DESC, mean, low) AS rn FROM (
  SELECT l_suppkey AS code, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS month, CAST(l_linenumber AS INT) AS level, CAST(l_quantity AS DOUBLE) AS mean, CAST(l_extendedprice AS DOUBLE) AS low FROM lineitem)) WHERE rn = 1""")
def stream_best_version(spark, d):
    """The best version of each station's months, by a stream over the table that keeps what it has seen."""
    rows = spark.readStream.schema(table(spark, d, "lineitem").schema).parquet(f"{d}/[l]ineitem.parquet")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month")
    told = rows.select(F.col("l_suppkey").alias("code"), month, F.col("l_linenumber").alias("level"), F.col("l_quantity").alias("mean"), F.col("l_extendedprice").alias("low"))
    path = _scratch(spark, "best")
    memory.start(memory.improvements(told, "code", "month", "level", ["mean", "low"]), f"{path}/log", f"{path}/state").awaitTermination()
    return memory.best(spark.read.parquet(f"{path}/log"), "code", "month", "level", ["mean", "low"])
