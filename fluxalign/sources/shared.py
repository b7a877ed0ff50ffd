"""The folder that all machines of a cluster share, and frames cut from their lineage there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one set, or the one that spark.checkpoint.dir names.

    A local session without either gets a temporary folder; on a cluster that is an error, since
    machines don't see each other's folders.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp()
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder; what is computed from it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
