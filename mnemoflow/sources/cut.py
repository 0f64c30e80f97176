"""Cutting the lineage of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one (tests, a laptop) gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", "")
        if not where:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            where = tempfile.mkdtemp(prefix="mnemoflow-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        context.setCheckpointDir(where)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read from there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path under the session's checkpoint folder, for tables that last as long as it does."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
