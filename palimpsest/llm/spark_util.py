"""Session helpers of the training-data operators: shared scratch tables, bounded Arrow batches, components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of the Arrow batches that Python workers get, so that a batch of long texts stays small.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Largest table, in bytes of its rows, that is broadcast; beyond it a shuffled join is used.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there and lost executors don't matter."""
    path = scratch_path(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: The tables that the innermost ``discarding`` blocks have written.
_OPEN: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def discarding():
    """Delete the tables that are materialized inside when the block ends, but for those given to ``keep``.

    A kept table belongs to the block around this one, or to the cluster where there is none.
    """
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch)
        return df

    _OPEN.append([])
    try:
        yield keep
    finally:
        for spark, path in _OPEN.pop():
            if path not in kept:
                remove(spark, path)
            elif _OPEN:
                _OPEN[-1].append((spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, whichever store it lies in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold the session's Arrow batches to ``rows`` rows and BATCH_BYTES bytes at most."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        now = int(now) if now and str(now).lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._palimpsest_shipped = True


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with bounded batches, on workers that have this package."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def with_id(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` is set; a null id names no row and can't be in a result."""
    return df.where(F.col(col).isNotNull())


def fits_broadcast(df: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, counted, take no more than ``bound`` bytes."""
    return df.count() * row_bytes <= bound


def bounded_join(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """Join with ``right`` broadcast if its counted size is within the bound, else shuffled (AQE splits hot keys)."""
    return left.join(F.broadcast(right) if fits_broadcast(right, row_bytes) else right, on, how)


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): ``node, component`` with the smallest node of each component.

    Alternates star contractions (larger neighbours, then smaller ones, go to the smallest neighbour); each round is
    written to the shared folder, until the edges no longer change. No adjacency list is gathered: a node's least neighbour is a
    partial aggregate, and the edges meet it by broadcast within the bound, else in a join of two plain exchanges, whose hot keys
    Spark splits.
    """

    def star(e: DataFrame, n: int, large: bool) -> DataFrame:
        """Large: every greater neighbour of u goes to the least of u and its neighbours; small: every lesser one."""
        around = e if not large else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        least = F.broadcast(least) if 2 * n * 16 <= BROADCAST_BYTES else materialize(least, f"{name}-least")
        joined = around.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    with discarding() as keep:
        now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        size = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"))
        was = None
        for _ in range(max_rounds):
            is_ = tuple(now.select(size.alias("x")).first().x)
            if is_ == was or is_[0] == 0:
                break
            was = is_
            now = materialize(star(star(now, is_[0], True), is_[0], False), name)
        else:
            raise RuntimeError("components did not settle")
        keep(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
