"""People and companies from a provider of named entities: whatever model is plugged in, its spans go through the same rules.

A provider takes units (doc_id, unit, text) and returns spans (doc_id, unit, start, end, type), half-open in code points, of type PERSON
or COMPANY (others are ignored). ``of_names`` makes one of a list of names; a model is one that loads in each worker, for instance within
``mapInPandas``. Short units in which it finds no person are asked again within a carrier sentence, as models see little in a bare table cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import predicates as P
from ..functions.spans import ENTITY, empty, entity, piece
from ..functions.stage import materialize, sorted_join
from .blocks import merge
from .detect import split_people
from .propagate import listed

Provider = Callable[[DataFrame], DataFrame]


def of_names(names: DataFrame) -> Provider:
    """A provider that knows the given names (value, type)."""
    return lambda units: listed(units, names).select("doc_id", "unit", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "type")


def accepted(units: DataFrame, spans: DataFrame, offset: int = 0) -> DataFrame:
    """``doc_id, unit, e``: spans of the units' texts, moved by ``offset``, that pass the rules for people and companies.

    Spans outside the text, of fewer than three characters and of public bodies leave; companies lose leading noise and
    need a legal form; people listed with slashes are split and each needs to look like a name.
    """
    rows = sorted_join(units.select("doc_id", "unit", "text"), spans.where(F.col("type").isin("PERSON", "COMPANY")), ["doc_id", "unit"])
    rows = rows.withColumns({"start": F.col("start") - offset, "end": F.col("end") - offset}).where((F.col("start") >= 0) & (F.col("end") <= F.length("text")))
    text, company = F.col("text"), F.col("type") == "COMPANY"
    raw = F.btrim(F.regexp_replace(piece(text, F.col("start"), F.col("end")), r"^\s+|\s+$", ""), F.lit(",;:"))
    rows = rows.withColumn("raw", raw).withColumn("value", F.when(company, P.clean_company(F.col("raw"))).otherwise(F.col("raw")))
    rows = rows.withColumn("start", F.col("start") + F.length("raw") - F.length("value"))
    rows = rows.where((F.length("value") >= L.MIN_NER) & ~F.lower("value").isin(*L.PUBLIC_BODIES) & (~company | P.plausible_company(F.col("value"))))

    def person(e):
        role, org = P.person_context(text, e["start"], e["end"])
        said = (role != "") | (org != "")
        return e.withField("role", F.when(said, role)).withField("org", F.when(said, org)).cast(ENTITY)

    whole = entity(F.col("value"), "PERSON", F.col("start"), F.col("end"), "ner")
    people = F.transform(F.filter(split_people(whole), lambda e: P.plausible_person(e["text"])), person)
    firm = F.array(entity(F.col("value"), "COMPANY", F.col("start"), F.col("end"), "ner"))
    return rows.select("doc_id", "unit", F.explode(F.when(company, firm).when(F.col("type") == "PERSON", people).otherwise(empty(ENTITY))).alias("e"))


def provided(units: DataFrame, provider: Provider) -> DataFrame:
    """``doc_id, unit, e``: what the provider finds in the units, then in a carrier sentence around short units without a person.

    The first is read twice, so it is written once: a provider is asked once, and the plan stays short.
    """
    plain = units.select("doc_id", "unit", "text")
    found = materialize(accepted(plain, provider(plain)), "provided")
    named = found.where("e.type = 'PERSON'").select("doc_id", "unit").distinct()
    short = sorted_join(plain.where(F.length("text") <= L.CARRIER_MAX), named, ["doc_id", "unit"], "left_anti")
    carried = short.withColumn("text", F.concat(F.lit(L.CARRIER_BEFORE), F.col("text"), F.lit(L.CARRIER_AFTER)))
    return found.unionByName(accepted(short, provider(carried), len(L.CARRIER_BEFORE)))


def with_names(unresolved: DataFrame, provider: Provider) -> DataFrame:
    """Units whose rule entities and provided ones are resolved together; ``unresolved`` holds all that the rules found."""
    return merge(unresolved, provided(unresolved, provider), resolved=False)


def names_in(text_units: DataFrame, provider: Provider) -> DataFrame:
    """``doc_id, unit`` and fields of a provider's entities in single texts, without the carrier sentence."""
    return accepted(text_units, provider(text_units.select("doc_id", "unit", "text"))).select("doc_id", "unit", "e.*")
