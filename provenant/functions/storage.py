"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it names none, a local session (as in tests) gets one of its
    own; a cluster raises, as a machine's own folder would hide each executor's part from the others."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="provenant-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; its lineage ends there, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is; it is counted no further than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
