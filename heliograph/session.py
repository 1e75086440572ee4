"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, set for checkpoints."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    set_before = sc._jsc.sc().getCheckpointDir()
    if not base and set_before.isDefined():
        return set_before.get()
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="spark-heliograph-")
    if not set_before.isDefined():
        sc.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; only a local master that names none (as in tests) gets a temporary one."""
    base = checkpoint_folder(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def landed(df: DataFrame, label: str = "round") -> DataFrame:
    """df as a table in the shared folder, read again.

    For loops: a checkpoint would carry what the planner knows of a frame's columns (constraints) from round to round, which grows without end.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
