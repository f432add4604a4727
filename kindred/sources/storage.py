"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="kindred-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables of one run, below one folder of the shared root.

    put() cuts the lineage: the rows are written as Parquet, so a lost executor costs a
    reread and the reader knows the table's size when it chooses a join.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_root(spark)}/kindred-{uuid.uuid4().hex}"
        self._next = 0

    def path(self, name: str) -> str:
        self._next += 1
        return f"{self.folder}/{self._next:04d}-{name}"

    def put(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def clear(self) -> None:
        """Drops all tables of the run; results must have been written before."""
        self.drop(self.folder)
