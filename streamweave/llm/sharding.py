"""Hilbert-curve sharding (operator 10).

Several metadata dimensions are quantised, each row gets the index of its cell
on a Hilbert curve, rows are sorted by that index and cut into runs.  Rows of
one shard are then close in every dimension, so the minimum and maximum of each
column in a file prune well.  Law `rows`: shard sizes differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.llm.common import arrow_udf, table
from streamweave.operators.ranking import numbered, running_total


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of n points with integer coordinates (n, dims).

    Coordinates are below 2**bits and bits * dims at most 63.  Gray-code walk from
    the highest bit down (the transposition form of the published algorithm).
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:  # undo the rotations and reflections of the coarser levels
        below = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(flip, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray encode
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = high
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[i] >> b & 1)
    return index


def text_marks(df: DataFrame, column: str, bits: int) -> list[str]:
    """The 2**bits - 1 values that stand at equal steps of the rows by a text column's order.

    Distinct values are counted with map-side combination and summed up over
    sorted ranges; at most 2**bits + 1 whole values reach the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = running_total(counts, F.col("n"), "value", name="before", total="rows")
    step = F.expr(f"(before * {1 << bits} + rows - 1) div rows")  # the first step that the value stands at
    found = dict(placed.groupBy(step.alias("step")).agg(F.max("value")).collect())
    marks, last = [], found.get(0)
    for j in range(1, 1 << bits):
        last = found.get(j, last)
        if last is not None:
            marks.append(last)
    return marks


def quantise(column, marks: list, kind: str):
    """A dimension's cell: how many of the marks the value reaches; nulls are in cell 0."""
    if not marks:
        return F.lit(0)
    text = kind == "string"
    value = column if text else column.cast("double")
    known = F.array(*[F.lit(m if text else float(m)) for m in marks])
    return F.coalesce(F.size(F.filter(known, lambda b: b <= value)), F.lit(0)).cast("int")


def hilbert_shards(df: DataFrame, dimensions: list[str], shards: int = 8, bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index) for each row.

    Dimensions are quantised at their quantiles, numbers and texts alike by value
    (2**bits - 1 marks each reach the driver), so that a shard's least and greatest
    value of each dimension lie close; nulls go to cell 0.  Rows are
    ordered by curve index, text checksum, then id; row r of N goes to the shard
    whose run of N / shards rows holds it.  Null texts have size 1 and the
    checksum of no bytes.  Equal rows each get a slot of their own.  An empty table
    gives an empty result; extra columns don't matter.
    """
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    numeric = [d for d in dimensions if kinds[d] != "string"]
    levels = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.select(*[F.col(d).cast("double").alias(d) for d in numeric]).approxQuantile(numeric, levels, 0.25 / (1 << bits)) if numeric else []
    marks = {d: sorted(b) for d, b in zip(numeric, found, strict=True)} | {d: text_marks(df, d, bits) for d in dimensions if d not in numeric}

    def curve(batches):
        for cells in batches:
            flat = np.asarray(cells.flatten()).reshape(len(cells), -1)
            yield pa.array(hilbert_index(flat, bits))

    index = arrow_udf(spark, curve, "long")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.array(*[quantise(F.col(d), marks[d], kinds[d]) for d in dimensions]).alias("cells"),
    ).withColumn("curve_index", index("cells")).drop("cells")
    order = ["curve_index", "text_crc32", "doc_id", "size"]
    ranked = numbered(rows, *order, name="rank", total="total")
    placed = ranked.withColumn("shard", F.expr(f"(rank * {shards} + {shards - 1}) div total"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - F.expr(f"(shard * total) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
    )


def write_shards(df: DataFrame, path: str, dimensions: list[str], shards: int = 8, bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows as Parquet, a folder per shard, each sorted by slot.

    Ids must be unique here, as the plan is joined back by id.
    """
    plan = hilbert_shards(df, dimensions, shards, bits, id_col, text_col).select(F.col("doc_id").alias("__plan_id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    rows = df.join(plan, df[id_col].eqNullSafe(plan["__plan_id"])).drop("__plan_id")
    ordered = rows.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    ordered.drop("__slot").withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hilbert_shards(docs, ["n_chars", "lang", "source"], shards=8, bits=5)
