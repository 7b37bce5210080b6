"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from civicframe.session import ship

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "file:///tmp/checkpoints/civicframe"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may leave it unset; a cluster's machines share no local folder."""
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_SHARED).rstrip("/")


#: A folder within the shared one, for what is written until ``scratch`` ends.
_scope: ContextVar[str] = ContextVar("scope", default="")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    p, files = _path(spark, path)
    files.delete(p, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """What operators write while this lasts is removed at its end, so results must have been written elsewhere by then."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        removed(spark, folder)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives the loss of any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
