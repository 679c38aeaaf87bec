"""Readers: declared schemas, lenient casts, optional inputs, ragged unions."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.operators.series import best_version
from streamweave.sources import geojson


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lake(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files below a folder, at any depth."""
    return spark.read.option("recursiveFileLookup", "true").parquet(folder)


def csv(spark: SparkSession, path: str, schema: str, null_value: str = "NULL") -> DataFrame:
    """CSV with header and a declared schema; what doesn't parse is null."""
    return spark.read.csv(path, schema=schema, header=True, nullValue=null_value, mode="PERMISSIVE")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One whole JSON document (or an array of records) per file."""
    reader = spark.read.option("multiLine", "true")
    return reader.schema(schema).json(path) if schema else reader.json(path)


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record per line: the splittable form of a large document."""
    return spark.read.schema(schema).json(path)


def geojson_features(spark: SparkSession, path: str, properties: str, coordinates: str = "array<array<double>>") -> DataFrame:
    """Features of a FeatureCollection: its properties, and geometry type and coordinates."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:{coordinates}>>>"
    features = json_document(spark, path, schema).select(F.explode("features").alias("f"))
    return features.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def geojson_scan(spark: SparkSession, path: str, properties: str, coordinates: str = "array<array<double>>", boundary: str | None = None) -> DataFrame:
    """As `geojson_features`, for documents of any size: read in splits, never as a whole.

    Features are found by the document's own structure.  Where the exact text is known
    that begins each of them, and stands nowhere else, `boundary` saves the pass that
    finds where splits begin.
    """
    if boundary is None:
        return geojson.features(spark, path, properties, coordinates)
    schema = f"properties struct<{properties}>, geometry struct<type:string,coordinates:{coordinates}>"
    records = spark.read.option("lineSep", boundary).text(path)
    parsed = records.select(F.from_json(F.concat(F.lit("{"), F.col("value")), schema).alias("f")).where("f.geometry is not null or f.properties is not null")
    return parsed.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def consult(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """A SQL query over frames that it names in braces, as in `SELECT * FROM {rain}`."""
    return spark.sql(query, **frames)


def xml_series(spark: SparkSession, path: str, row_tag: str, schema: str, keys: list[str], level: str, *then: str) -> DataFrame:
    """A series from XML documents, one row per key: the highest consistency level wins."""
    return best_version(xml_rows(spark, path, row_tag, schema), keys, level, *[F.col(c) for c in then])


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML document by tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that Spark reads it from."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty layer of the schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several Parquet paths that exists (the complete one first)."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def ragged_union(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def lenient(column: str, kind: str, alias: str | None = None):
    """Cast that gives null for what doesn't parse."""
    return F.expr(f"try_cast(`{column}` AS {kind})").alias(alias or column)
