"""Tables that cut lineage, in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only a local session
without one (tests, a laptop) gets a temporary folder; on a cluster its lack
is an error, as no other folder is known to be shared.

A table lives until the process ends, or, if it was made within
``temporary``, until that block is left.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: The Hadoop path of each table, by its name.
_MADE: dict[str, tuple] = {}
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@cache
def _own_folder() -> str:
    own = tempfile.mkdtemp(prefix="mnemoflow-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder, as Spark reads it."""
    where = spark.conf.get("spark.checkpoint.dir", "")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return _known(spark, f"{shared_folder(spark)}/mnemoflow/{name}-{uuid.uuid4().hex}")


def part(spark: SparkSession, path: str, name: str) -> str:
    """A folder of a table, which can be deleted before it."""
    return _known(spark, f"{path}/{name}")


def _known(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _MADE[path] = (at.getFileSystem(spark._jsc.hadoopConfiguration()), at)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def write(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once to ``path`` and read again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that a lost
    executor costs a re-read and not the whole lineage."""
    return write(df, new_path(df.sparkSession, name))


def delete(path: str) -> None:
    """Delete a table that nothing reads any more."""
    if made := _MADE.pop(path, None):
        made[0].delete(made[1], True)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables made inside are deleted at the end: what is needed after it must be written to a path made before."""
    own: list[str] = []
    token = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in own:
            delete(path)


@atexit.register
def _delete_all() -> None:
    for path in list(_MADE):
        try:
            delete(path)
        except (Py4JError, OSError):  # the session's JVM has gone
            return
