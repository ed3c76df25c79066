"""Known names: a vocabulary of each document, found again in all its lines; and a gazetteer as a name provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import predicates as P
from ..functions.spans import CLOSE, OPEN, entity, find
from ..functions.stage import sorted_join
from .blocks import merge
from .detect import entities


#: Most names of a list that are sent to all workers; a longer list is joined by sorting.
MAX_SENT = 50_000


def vocabulary(detected: DataFrame) -> DataFrame:
    """``doc_id, value, type`` of people and companies of six characters or more; the last mention decides the type."""
    e = entities(detected).where(F.col("type").isin("PERSON", "COMPANY") & (F.length("text") >= L.MIN_PROPAGATED))
    return e.groupBy("doc_id", F.col("text").alias("value")).agg(F.max_by("type", F.struct("unit", "start", "ord")).alias("type"))


def occurrences(units: DataFrame, vocab: DataFrame, source: str = "propagated") -> DataFrame:
    """``doc_id, unit, e``: each place where a known value stands in a unit of its document, in any case."""
    hits = sorted_join(units.select("doc_id", "unit", "text"), vocab, "doc_id").where(F.contains(F.lower("text"), F.lower("value")))
    pattern = F.concat(F.lit(r"(?iu)\Q"), F.replace(F.col("value"), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    spans = find(F.col("text"), pattern, F.lit(f"{OPEN}$0{CLOSE}"))
    return named(hits.select("doc_id", "unit", "text", "type", F.explode(spans).alias("s")), source)


def named(rows: DataFrame, source: str) -> DataFrame:
    """``doc_id, unit, e`` of spans ``s`` in texts; people with the role and company said beside them."""
    text, start, end = F.col("s.text"), F.col("s.start"), F.col("s.end")
    role, org = P.person_context(F.col("text"), start, end)
    said = (role != "") | (org != "")
    person = entity(text, "PERSON", start, end, source, F.when(said, role), F.when(said, org))
    return rows.select("doc_id", "unit", F.when(F.col("type") == "PERSON", person).otherwise(entity(text, "COMPANY", start, end, source)).alias("e"))


def propagate(detected: DataFrame) -> DataFrame:
    return merge(detected, occurrences(detected, vocabulary(detected)))


def gazetteer(detected: DataFrame, names: DataFrame) -> DataFrame:
    """Units with the entities of a list of names (value, type), as they are listed."""
    return merge(detected, named(listed(detected, names), "ner"))


def listed(units: DataFrame, names: DataFrame, most_sent: int = MAX_SENT) -> DataFrame:
    """``doc_id, unit, text, type, s``: whole occurrences of listed names, in any case.

    Names meet units on their first word (lower case), an equi-join on ids and words; texts join the matching units once.
    """
    first = F.lower(F.element_at(F.split(F.trim("value"), r"\s+"), 1))
    words = units.select("doc_id", "unit", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}&.'-]+"))).alias("_w"))
    known = names.select("value", "type", first.alias("_w"))
    # the words grow with the input and must never be what is broadcast; the names are, if they are few
    known = F.broadcast(known) if names.limit(most_sent + 1).count() <= most_sent else known.hint("merge")
    met = words.join(known, "_w").select("doc_id", "unit", "value", "type").distinct()
    rows = sorted_join(units.select("doc_id", "unit", "text"), met, ["doc_id", "unit"]).where(F.contains(F.lower("text"), F.lower("value")))
    pattern = F.concat(F.lit(r"(?iu)\b\Q"), F.replace(F.col("value"), F.lit(r"\E"), F.lit("")), F.lit(r"\E\b"))
    return rows.select("doc_id", "unit", "text", "type", F.explode(find(F.col("text"), pattern, F.lit(f"{OPEN}$0{CLOSE}"))).alias("s"))
