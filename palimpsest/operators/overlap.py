"""Greedy resolution of overlapping entities of one unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.spans import ENTITY, empty


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(ents: Column) -> Column:
    """Keep, in order of priority, length, start and place, each entity disjoint from those kept; losers go whole. By start."""
    rank = F.create_map(*(F.lit(x) for kv in L.PRIORITY.items() for x in kv))
    keyed = F.transform(ents, lambda e: F.struct((-F.coalesce(F.element_at(rank, e["type"]), F.lit(0))).alias("p"), (e["start"] - e["end"]).alias("n"), e["start"].alias("s"), e["ord"].alias("o"), e.alias("e")))
    kept = F.aggregate(F.transform(F.array_sort(keyed), lambda k: k["e"]), empty(ENTITY), lambda acc, c: F.when(F.exists(acc, lambda k: overlaps(k, c)), acc).otherwise(F.concat(acc, F.array(c))))
    ordered = lambda of: F.transform(F.array_sort(F.transform(of, lambda e: F.struct(e["start"].alias("s"), e["ord"].alias("o"), e.alias("e")))), lambda k: k["e"])
    # where no two neighbours by start overlap, none do: a line of any number of entities is sorted once
    n, sorted_ = F.size(ents) - 1, ordered(ents)
    apart = F.forall(F.arrays_zip(F.slice(sorted_, 1, n).alias("a"), F.slice(sorted_, 2, n).alias("b")), lambda p: p["a"]["end"] <= p["b"]["start"])
    return F.when(n > 0, F.when(apart, sorted_).otherwise(ordered(kept))).otherwise(ents)
