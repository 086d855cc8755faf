"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage like a checkpoint, but is columnar and outlives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only for a single-process master that names none."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestat-llm-")
    spark.conf.set(_KEY, own)
    return own


class Scratch:
    """Tables of one operator call. What is not dropped earlier goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def _system(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path, jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def store(self, df: DataFrame) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        jvm_path, system = self._system(path)
        system.deleteOnExit(jvm_path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *stored: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df, path in self.tables:
            if any(df is x for x in stored):
                jvm_path, system = self._system(path)
                system.delete(jvm_path, True)
