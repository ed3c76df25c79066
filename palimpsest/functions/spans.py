"""Spans with exact offsets by column expressions: mark matches with two private-use characters, split, and sum lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of a match's start, end and inner border; texts are cleaned of them when units are made.
OPEN, CLOSE, INNER = "\ue000", "\ue001", "\ue002"
SPAN = "struct<text:string,start:int,end:int,mark:int>"
ENTITY = "struct<text:string,type:string,start:int,end:int,source:string,role:string,org:string,ord:int>"


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def find(text: Column, pattern: str | Column, marked: str | Column = f"{OPEN}$0{CLOSE}", gate: Column | None = None) -> Column:
    """All matches from left to right as (text, start, end, mark): half-open, in code points; ``mark`` is the inner border's offset.

    The pattern is tried first as a plain predicate, so units without a match cost one search and no interpreted lambda.
    ``gate``: a cheaper condition that every match implies, tried before the pattern.
    """
    # every second part is a match; parts go in chunks, so that arrays grow within a chunk only, however many matches a line has
    parts = F.split(F.regexp_replace(text, pattern, marked), f"[{OPEN}{CLOSE}]")
    few = F.size(parts) <= CHUNK
    starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(CHUNK))
    chunks = F.transform(starts, lambda i: F.slice(parts, i + 1, CHUNK))
    ends = F.aggregate(F.transform(chunks, _shown), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    many = F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), ends.alias("e")), lambda x: F.coalesce(_spans(x["c"], x["e"]), empty(SPAN))))

    matches = F.rlike(text, pattern if isinstance(pattern, Column) else F.lit(pattern))
    found = matches if gate is None else gate & matches
    return F.when(found, F.when(few, _spans(parts, F.lit(0))).otherwise(many)).otherwise(empty(SPAN))


#: Parts of one chunk of a marked text, an even number: its first part is none of the matches.
CHUNK = 512


def _shown(parts: Column) -> Column:
    """Characters of parts without inner marks."""
    return F.length(F.replace(F.array_join(parts, ""), F.lit(INNER), F.lit("")))


def _spans(parts: Column, at: Column) -> Column:
    """The spans of the parts at odd places; the first part begins at offset ``at``."""

    def step(acc, x):
        clean = F.replace(x, F.lit(INNER), F.lit(""))
        end = acc["pos"] + F.length(clean)
        inner = F.when(F.contains(x, F.lit(INNER)), acc["pos"] + F.length(F.substring_index(x, INNER, 1)))
        span = F.struct(clean.alias("text"), acc["pos"].alias("start"), end.alias("end"), inner.alias("mark")).cast(SPAN)
        return F.struct(end.alias("pos"), (~acc["on"]).alias("on"), F.when(acc["on"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(at.cast("int").alias("pos"), F.lit(False).alias("on"), empty(SPAN).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def piece(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def before(text: Column, start: Column, n: int) -> Column:
    """The ``n`` characters before an offset, fewer at the text's start."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def entity(text, type_, start, end, source, role=None, org=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(text.alias("text"), F.lit(type_).alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(source).alias("source"), (none if role is None else role).alias("role"), (none if org is None else org).alias("org"), F.lit(0).alias("ord")).cast(ENTITY)


def numbered(ents: Column) -> Column:
    """Entities with their place in the list as ``ord``, the last tie-break of the overlap rule."""
    return F.transform(ents, lambda e, i: e.withField("ord", i)).cast(f"array<{ENTITY}>")


def once(value: Column) -> Column:
    """The value, evaluated where it stands.

    Catalyst copies a deterministic column into every filter on it (also those that it infers from ``explode``), and a column of
    detected entities is dear. It isn't moved past an expression that it takes for non-deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
