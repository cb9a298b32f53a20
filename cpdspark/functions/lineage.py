"""Materialise a table that several later steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


BROADCAST_ROWS = 500_000
VECTOR_ROWS = 50_000  # rows with a vector are larger


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a temporary folder; a cluster is refused.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cpdspark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder.

    The result survives the loss of executors, and later plans start from it instead of
    repeating what led to it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sized(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a lookup table; hint a broadcast if its counted rows are few.

    The rows that look it up are then not shuffled. A larger table is left to a shuffle join,
    where Spark's adaptive execution splits skewed keys.
    """
    done = cut(table)
    return F.broadcast(done) if done.count() <= limit else done
