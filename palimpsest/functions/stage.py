"""Intermediate tables in the shared folder, for results that several later steps read."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written within the open ``discarded`` blocks, innermost last.
_WRITTEN: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder of the warehouse where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/palimpsest-stages"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet and read back: later readers prune columns, and lost executors repeat no earlier step."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join by sorting, never by broadcast: Spark's estimates count neither what ``explode`` nor what text expressions add to a
    small table, so what it takes for small may not fit the driver. For sides that grow with the input."""
    return left.join(right.hint("merge"), on, how)


def _delete(written: list[tuple[SparkSession, str]]) -> None:
    while written:
        spark, path = written.pop()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard_run() -> None:
    """Delete what the innermost open block has written so far."""
    if _WRITTEN:
        _delete(_WRITTEN[-1])


@contextmanager
def discarded() -> Iterator[None]:
    """Tables materialized inside are deleted when the block ends: for runs whose results are written within it."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        _delete(_WRITTEN.pop())
