"""Annotated truth from JSON: a bare array of entities, or an object with a scope of units and the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "array<struct<text:string,type:string>>"
SCOPED = f"struct<scope:struct<unit_start:int,unit_end:int>,entities:{ITEMS}>"


def parse_annotations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``corpus, ord, text, type`` and ``corpus, unit_start, unit_end`` of ``files`` (corpus, json); without a scope all units count."""
    bare = F.from_json("json", ITEMS)
    scoped = F.from_json("json", SCOPED)
    whole = F.ltrim("json").startswith("[")
    items = F.when(whole, bare).otherwise(scoped["entities"])
    entities = files.select("corpus", F.posexplode(items).alias("ord", "e")).select("corpus", "ord", "e.text", "e.type")
    bounds = F.when(~whole, scoped["scope"])
    scope = files.select("corpus", F.coalesce(bounds["unit_start"], F.lit(0)).alias("unit_start"), F.coalesce(bounds["unit_end"], F.lit(2**31 - 1)).alias("unit_end"))
    return entities, scope


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The annotation files of a folder; a file's name without its suffix is the corpus."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)
    return parse_annotations(spark.read.text(path, wholetext=True).select(name.alias("corpus"), F.col("value").alias("json")))
