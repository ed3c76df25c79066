"""A folder of incoming documents as a stream: each is rewritten once as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.stage import discarded
from ..operators.detect import detect, entities
from ..plans.pipeline import redact
from ..sources.units import units


def incoming(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def entity_stream(docs: DataFrame) -> DataFrame:
    """Entities of a stream of documents: detection is stateless, so it is the batch plan."""
    return entities(detect(units(docs)))


def redact_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Rewrite each micro-batch whole, as stand-ins are numbered within a document; runs until the waiting files are done.

    A batch writes to a folder of its own number, so that a batch repeated after a failure replaces its first try.
    """

    def write(batch: DataFrame, number: int) -> None:
        with discarded():
            redact(batch).redacted.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired(files: DataFrame, seconds: int = 3600, now=None) -> DataFrame:
    """Files (``path, modificationTime``) older than the time they are kept for."""
    at = F.current_timestamp() if now is None else F.lit(now)
    return files.where(F.col("modificationTime") < at - F.make_dt_interval(secs=F.lit(seconds)))
