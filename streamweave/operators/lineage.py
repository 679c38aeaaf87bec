"""Cutting a plan's lineage with reliable checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names.

    A temporary folder stands in for it only where driver and executors are one
    process (local master); on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="streamweave-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly: each will grow to many, however few files or tasks they come from."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


class Tables:
    """The tables of an iterative job, written below the shared folder.

    A checkpoint keeps its plan's estimated size, and a join multiplies estimates, so
    over many rounds they grow without bound; a written table has the size that it
    has.  A table can be dropped as soon as no later one is read from it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, *folders: str) -> DataFrame:
        """Write a table, in folders by the values of some columns if any are named, and read it."""
        path = f"{self.base}/{len(self.paths)}"
        df.write.partitionBy(*folders).parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = made
        return made

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path, made in self.paths.items():
            if made is not None and any(made is t for t in tables):
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)
                self.paths[path] = None

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*[t for t in self.paths.values() if t is not None and not any(t is k for k in kept)])
