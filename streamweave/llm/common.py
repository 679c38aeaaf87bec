"""Helpers shared by the training-data operators.

Nothing in the rest of the library imports this subpackage.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.functions.shipping import ship_package
from streamweave.llm import worker
from streamweave.operators.lineage import cut_lineage

#: Rows, and bytes of them, that a Python worker holds as Python objects at a time.
SLICE, SLICE_BYTES = 1000, 32 << 20


def slices(batch):
    """The batch in parts of at most SLICE rows and, but for single rows, SLICE_BYTES."""
    stack = [batch.slice(i, SLICE) for i in range(0, len(batch), SLICE)][::-1]
    while stack:
        part = stack.pop()
        if len(part) > 1 and part.nbytes > SLICE_BYTES:
            half = len(part) // 2
            stack += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def arrow_udf(spark: SparkSession, function, kind: str):
    """An Arrow UDF over an iterator of small slices; the package goes along to the workers."""
    ship_package(spark)
    operator = f"{function.__module__}.{function.__qualname__}"

    def sliced(batches):
        worker.begin(operator)
        return function(part for b in batches for part in slices(b))

    sliced.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return F.arrow_udf(sliced, kind, F.ArrowUDFType.SCALAR_ITER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's Parquet tables through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to `names` that `df` does not have (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate, i = f"__{name}", 0
        while candidate.lower() in taken:
            i += 1
            candidate = f"__{name}_{i}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the columns that an operator is about to produce (its own win)."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    return cut_lineage(df)


@contextmanager
def shuffles_go(spark: SparkSession):
    """Within it the shuffle files of a query go as soon as it ends.

    Otherwise those of all the steps of an iterative job lie on the executors' disks
    until the driver happens to collect its garbage.  While a query runs they are
    kept, so a lost executor's part is made again as always.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def hash_share(*columns) -> Column:
    """A number in [0, 1) from the hash of the columns: rows are drawn by it, alike wherever they lie."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str) -> bytes:
    """UTF-8 of a text; lone surrogates (never produced by Spark) are replaced."""
    return text.encode("utf-8", "replace")


def crc_mod(column, modulus: int):
    """crc32 of the id written as text, modulo `modulus`, JVM-side."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def code_points(text: str) -> np.ndarray:
    """The text's code points as an int32 array."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
