"""The folder that driver and executors share, and cuts of long lineages in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and all runs in this process, as in tests."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if known is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        known = tempfile.mkdtemp(prefix="tremorlake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def cut(frame: DataFrame) -> DataFrame:
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
