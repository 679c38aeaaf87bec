"""The surrogate inputs that the queries build from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.operators.codec import DIGITS
from streamweave.sources.tables import table

WINDOWS = {"before": (1995, 1997), "after": (1999, 2001)}


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """(code, year, month, value): monthly mean per station."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.avg("l_quantity").alias("value"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(code, day, value, dry): daily mean per station and whether it was dry."""
    li = table(spark, d, "lineitem")
    dry = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.10)
    return li.groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("value"), F.max(dry).alias("dry"))


def annual(spark: SparkSession, d: str, least: int = 10) -> DataFrame:
    """(code, year, value): mean of years with at least `least` months."""
    from streamweave.operators.series import complete_periods

    return complete_periods(monthly(spark, d), ["code", "year"], F.round(F.avg("value"), 8).alias("value"), least)


def stations(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("state"), F.col("r_name").alias("basin"), F.col("s_acctbal").alias("area"))


def heap(spark: SparkSession, d: str) -> DataFrame:
    """A shallow forest over parts: each drains to half its key."""
    p = table(spark, d, "part")
    down = F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2"))
    return p.select(F.col("p_partkey").alias("id"), down.alias("down"), F.col("p_retailprice").alias("area"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))


def deep(spark: SparkSession, d: str) -> DataFrame:
    """A forest about a third as deep as it has nodes."""
    p = table(spark, d, "part")
    to = F.col("p_partkey") - 1 - F.col("p_partkey") % 3
    return p.select(F.col("p_partkey").alias("id"), F.when(to >= 0, to).alias("down"), F.col("p_retailprice").alias("area"), F.col("p_name").alias("name"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y, label): two components of each vector."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("long").alias("label"))


def dangling(spark: SparkSession, d: str) -> DataFrame:
    """The shallow forest without every eleventh node: its children drain to keys that no row has."""
    return heap(spark, d).where("id % 11 <> 5")


def reaches(spark: SparkSession, d: str) -> DataFrame:
    """The shallow forest with a place (x, y) and an area of its own for each node."""
    h = heap(spark, d)
    return h.select("id", "down", ((F.col("id") * 37 % 1009).cast("double") / 1009).alias("x"), ((F.col("id") * 53 % 997).cast("double") / 997).alias("y"), F.col("area").alias("own_area"), "size")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(line, x1, y1, x2, y2): from each even point to the next one."""
    p = points(spark, d)
    a, b = p.where("id % 2 = 0"), p.where("id % 2 = 1")
    b = b.select((F.col("id") - 1).alias("line"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.select(F.col("id").alias("line"), F.col("x").alias("x1"), F.col("y").alias("y1")).join(b, "line")


MONTHLY = """monthly AS (SELECT l_suppkey AS code, year(l_shipdate) AS year, month(l_shipdate) AS month, avg(l_quantity) AS value
  FROM lineitem GROUP BY ALL)"""
DAILY = """daily AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS value,
  bool_or(l_returnflag = 'R' AND l_quantity >= 50 AND l_discount >= 0.10) AS dry FROM lineitem GROUP BY ALL)"""
ANNUAL = MONTHLY + """,
annual AS (SELECT code, year, round(avg(value), 8) AS value FROM monthly GROUP BY code, year HAVING count(*) >= 10)"""
STATIONS = """stations AS (SELECT s_suppkey AS code, s_name AS name, n_name AS state, r_name AS basin, s_acctbal AS area
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
HEAP = "heap AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS down, p_retailprice AS area, p_name AS name, p_size AS size FROM part)"
DEEP = "deep AS (SELECT p_partkey AS id, CASE WHEN p_partkey - 1 - p_partkey % 3 >= 0 THEN p_partkey - 1 - p_partkey % 3 END AS down, p_retailprice AS area, p_name AS name FROM part)"
DANGLING = HEAP + ", dangling AS (SELECT id, CASE WHEN down % 11 <> 5 THEN down END AS down, area FROM heap WHERE id % 11 <> 5)"
REACHES = HEAP + ", reaches AS (SELECT id, down, (id * 37 % 1009)::DOUBLE / 1009 AS x, (id * 53 % 997)::DOUBLE / 997 AS y, area AS own_area, size FROM heap)"
POINTS = "points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS BIGINT) AS label FROM embeddings)"
SEGMENTS = POINTS + """,
segments AS (SELECT a.id AS line, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM points a JOIN points b ON b.id = a.id + 1 WHERE a.id % 2 = 0)"""
#: Distance of point (x, y) to segment (x1, y1)-(x2, y2), in SQL.
DISTANCE = """sqrt(power(x - (x1 + t * (x2 - x1)), 2) + power(y - (y1 + t * (y2 - y1)), 2))"""
PROJECT = """CASE WHEN (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) > 0 THEN greatest(0.0, least(1.0, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) ELSE 0.0 END AS t"""


def varint_sql(value: str) -> str:
    """SQL for the varint text of one number."""
    z = f"CASE WHEN {value} < 0 THEN -2 * ({value}) - 1 ELSE 2 * ({value}) END"
    groups = f"greatest(1, (length(bin({z})) + 4) // 5)"
    return f"array_to_string(list_transform(range(0, {groups}), lambda k: substr('{DIGITS}', CAST((({z}) >> (5 * k)) & 31 AS INT) + CASE WHEN k < {groups} - 1 THEN 32 ELSE 0 END + 1, 1)), '')"
