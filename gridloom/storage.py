"""Cutting lineage: written to the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is made only where the session has none and runs locally."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"gridloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written to the shared folder and read from there: survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"
