"""Same-named people told apart by what is said about them: contexts are clustered by name, mentions get their cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import contexts_conflict, normalise
from ..functions.stage import sorted_join

GROUP = "struct<role:string,org:string>"


def cluster_fold(contexts: Column) -> Column:
    """Fold sorted contexts: each joins the first group it does not conflict with, filling empty halves, else starts one."""
    empty = F.array().cast(f"array<{GROUP}>")

    def step(groups, c):
        fits = F.transform(groups, lambda g: ~contexts_conflict(g["role"], g["org"], c["role"], c["org"]))
        at = F.array_position(fits, F.lit(True)).cast("int")
        filled = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct(F.when(g["role"] == "", c["role"]).otherwise(g["role"]).alias("role"), F.when(g["org"] == "", c["org"]).otherwise(g["org"]).alias("org"))).otherwise(g))
        return F.when(at > 0, filled).otherwise(F.concat(groups, F.array(c))).cast(f"array<{GROUP}>")

    return F.aggregate(F.array_sort(contexts), empty, step)


def clusters(ents: DataFrame) -> DataFrame:
    """``doc_id, name, groups`` of people with any context."""
    people = ents.where((F.col("type") == "PERSON") & F.col("role").isNotNull())
    seen = people.groupBy("doc_id", normalise(F.col("text")).alias("name")).agg(F.collect_set(F.struct("role", F.coalesce("org", F.lit("")).alias("org"))).alias("seen"))
    return seen.select("doc_id", "name", cluster_fold(F.col("seen")).alias("groups"))


def resolve_identities(ents: DataFrame) -> DataFrame:
    """Entities with ``ctx``: ``#i`` for people whose name has several clusters, else null."""
    known = clusters(ents).where(F.size("groups") > 1).withColumnRenamed("name", "_name")
    named = ents.withColumn("_name", F.when(F.col("type") == "PERSON", normalise(F.col("text"))))
    role, org = F.coalesce("role", F.lit("")), F.coalesce("org", F.lit(""))
    free = F.transform("groups", lambda g: ~contexts_conflict(g["role"], g["org"], role, org))
    at = F.greatest(F.array_position(free, F.lit(True)).cast("int") - 1, F.lit(0))
    return sorted_join(named, known, ["doc_id", "_name"], "left").withColumn("ctx", F.when(F.col("groups").isNotNull(), F.concat(F.lit("#"), at.cast("string")))).drop("_name", "groups")
