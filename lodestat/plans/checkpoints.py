"""Cutting lineage safely.

Range partitioning samples its input, so two evaluations of the same plan may
place rows differently. Whoever reads partition numbers must therefore store
the partitioned rows first. They go to the reliable checkpoint folder, so a
lost executor costs a re-read and not a different answer.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a single-process session gets a folder of its own; a
    cluster must name one, since executors do not share the driver's disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestat-checkpoint-")
    sc.setCheckpointDir(named)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return the stored copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
