"""Small tables that a job writes for its own later steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Of tables that a job writes for itself, and of those that it keeps.
CODEC = "zstd"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a temporary folder only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A write made meanwhile removes its shuffles from the executors' disks as it ends; else they lie there until the driver
    happens to collect its garbage. The session gets its own setting back."""
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
