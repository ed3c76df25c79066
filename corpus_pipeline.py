"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

quality classifier -> line dedup by source -> near-dedup on five-word shingles -> benchmark decontamination -> byte-level BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontamination, line_dedup, near_dup, prefix_bpe, quality_classifier
from palimpsest.llm.queries import rank_bytes, table
from palimpsest.llm.spark_util import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier takes for good (score of 0.5 or more)."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_classifier.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's boilerplate lines out of the texts; every document stays."""
    return line_dedup.drop_boilerplate(docs, host="source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class."""
    return near_dup.keep_one(docs, near_dup.NearDup(shingle=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents with their token ids, counts and digests of the ids and of the bytes decoded from them."""
    return prefix_bpe.encode_texts(docs, rank_bytes(), keep_ids=True, keep=tuple(docs.columns))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("byte_bpe", encode)]

#: The stages learn a model, close over verified links and tokenize: not SQL. ``tests/llm/test_pipeline.py`` holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
