"""Addresses split over consecutive short lines: blocks by windows, one match a block, fragments by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.spans import ENTITY, INNER, entity, numbered, piece
from ..functions.stage import sorted_join
from .detect import address_tail, postcode_valid
from .overlap import resolve


def blocks(detected: DataFrame) -> DataFrame:
    """``doc_id, block, members``: runs of two to five joinable lines, in order. One shuffle by document."""
    joinable = (F.length("text") <= L.MAX_LINE) & (F.size("ents") == 0) & ~F.col("text").rlike(L.LABELLED_FIELD)
    order = Window.partitionBy("doc_id").orderBy("unit")
    marked = detected.select("doc_id", "unit", "text", joinable.alias("ok")).withColumn("island", F.sum((~F.col("ok")).cast("int")).over(order)).where("ok")
    within = Window.partitionBy("doc_id", "island").orderBy("unit")
    chunk = F.floor((F.row_number().over(within) - 1) / L.MAX_BLOCK)
    grouped = marked.withColumn("chunk", chunk).groupBy("doc_id", "island", "chunk").agg(F.array_sort(F.collect_list(F.struct("unit", "text"))).alias("members"))
    return grouped.where(F.size("members") >= 2).select("doc_id", F.concat_ws("/", "island", "chunk").alias("block"), "members")


def multiline_addresses(detected: DataFrame) -> DataFrame:
    """``doc_id, unit, e``: the fragment of each line of every stitched address. Blocks without a postcode leave before any lambda runs."""
    joined = blocks(detected).withColumn("joined", F.array_join(F.transform("members", lambda m: F.trim(m["text"])), ", ")).where(F.col("joined").rlike(L.POSTCODE))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<unit:int,text:string,s:int,e:int>>").alias("out"))

    def step(acc, m):
        n = F.length(F.trim(m["text"]))
        span = F.struct(m["unit"].alias("unit"), m["text"].alias("text"), acc["pos"].alias("s"), (acc["pos"] + n).alias("e"))
        return F.struct((acc["pos"] + n + 2).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = joined.withColumn("spans", F.aggregate("members", start, step, lambda a: a["out"]))
    anchored = f"(?s)^{L.ADDRESS}.*$"
    text = F.col("joined")

    def candidate(s):
        rest = F.substring(text, s["s"] + 1, F.length(text))
        head = F.substring(rest, 1, L.BLOCK_HEAD)
        marked = F.regexp_replace(rest, anchored, "$1" + INNER + "$2")
        first = F.length(F.substring_index(marked, INNER, 1))
        ok = head.rlike("[0-9]") & ~head.rlike(L.NON_ADDRESS_LINE) & rest.rlike(anchored) & postcode_valid(text, s["s"] + first)
        return F.struct(ok.alias("ok"), s["s"].alias("s"), (s["s"] + F.length(marked) - 1).alias("e"))

    hit = spans.withColumn("hit", F.get(F.filter(F.transform("spans", candidate), lambda c: c["ok"]), F.lit(0))).where("hit is not null")
    ended = hit.withColumn("m_s", F.col("hit.s")).withColumn("m_e", address_tail(text, F.col("hit.e")))
    touched = ended.withColumn("touched", F.filter("spans", lambda s: (s["s"] < F.col("m_e")) & (F.col("m_s") < s["e"])))
    good = touched.where((F.size("touched") >= L.MIN_TOUCHED) & F.contains(piece(text, F.col("m_s"), F.col("m_e")), F.lit(",")))
    cut = good.select("doc_id", "m_s", "m_e", F.explode("touched").alias("t"))
    lead = F.length(F.col("t.text")) - F.length(F.ltrim(F.col("t.text")))
    lo = F.greatest(F.col("m_s"), F.col("t.s")) - F.col("t.s")
    hi = F.least(F.col("m_e"), F.col("t.e")) - F.col("t.s")
    part = cut.select("doc_id", F.col("t.unit").alias("unit"), F.trim("t.text").alias("raw"), lead.alias("lead"), lo.alias("lo"), hi.alias("hi")).withColumn("frag", piece(F.col("raw"), F.col("lo"), F.col("hi")))
    return part.where(F.length(F.trim("frag")) >= L.MIN_FRAGMENT).select("doc_id", "unit", entity(F.col("frag"), "ADDRESS", F.col("lead") + F.col("lo"), F.col("lead") + F.col("hi"), "rule-multiline").alias("e"))


def merge(detected: DataFrame, extra: DataFrame, resolved: bool = True) -> DataFrame:
    """Detected units with further entities (doc_id, unit, e) resolved among theirs; ``resolved``: whether theirs are already."""
    more = extra.groupBy("doc_id", "unit").agg(F.array_sort(F.collect_list("e")).alias("_more"))
    both = sorted_join(detected, more, ["doc_id", "unit"], "left").withColumn("_all", numbered(F.concat("ents", F.coalesce("_more", F.array().cast(f"array<{ENTITY}>")))))
    return both.select(*[c for c in detected.columns if c != "ents"], (F.when(F.col("_more").isNull(), F.col("ents")).otherwise(resolve(F.col("_all"))) if resolved else resolve(F.col("_all"))).alias("ents"))


def stitch(detected: DataFrame) -> DataFrame:
    return merge(detected, multiline_addresses(detected))
