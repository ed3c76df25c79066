"""Stable stand-ins: every identity of a document gets one, numbered by first sight, of the type's shape."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import lexicons as L
from ..functions.predicates import digits, normalise
from ..functions.shipping import ship


def key_of(type_: Column, text: Column) -> Column:
    return F.when(type_ == "PHONE", digits(text)).otherwise(normalise(text))


def ordinals(ents: DataFrame) -> DataFrame:
    """``doc_id, type, key, ctx, n, first_seen, first_unit, first_start``: identities in order of first sight (unit up, start down)."""
    ctx = F.coalesce(F.when(F.col("type") == "PERSON", F.col("ctx")), F.lit("")) if "ctx" in ents.columns else F.lit("")
    sight = F.struct("unit", (-F.col("start")).alias("back"))
    first = ents.groupBy("doc_id", "type", key_of(F.col("type"), F.col("text")).alias("key"), ctx.alias("ctx")).agg(F.min(F.struct(sight.alias("at"), F.col("text"))).alias("f"))
    order = Window.partitionBy("doc_id", "type").orderBy("f.at")
    return first.select("doc_id", "type", "key", "ctx", F.row_number().over(order).cast("long").alias("n"), F.col("f.text").alias("first_seen"), F.col("f.at.unit").alias("first_unit"), (-F.col("f.at.back")).alias("first_start"))


def fake_name(n: Column) -> Column:
    first, last = (F.array(*map(F.lit, names)) for names in (L.FIRST_NAMES, L.LAST_NAMES))
    name = F.concat_ws(" ", F.element_at(first, (n % len(L.FIRST_NAMES) + 1).cast("int")), F.element_at(last, (n % len(L.LAST_NAMES) + 1).cast("int")))
    cycle = F.floor((n - 1) / (len(L.FIRST_NAMES) * len(L.LAST_NAMES)))
    return F.when(cycle > 0, F.concat_ws(" ", name, (cycle + 1).cast("string"))).otherwise(name)


def fake(type_: Column, n: Column, text: Column) -> Column:
    """The stand-in of the n-th identity of a type."""
    pad = lambda x, k: F.lpad(x.cast("string"), k, "0")
    lines, forms = F.array(*map(F.lit, L.ADDRESS_LINES)), F.array(*map(F.lit, L.COMPANY_FORMS))
    last = F.array(*map(F.lit, L.LAST_NAMES))
    address = F.when(F.length(text) <= L.SHORT_ADDRESS, F.element_at(lines, (n % 5 + 1).cast("int"))).otherwise(F.concat((100 + n).cast("string"), F.lit(" Example Street, Sector "), (n % 20 + 1).cast("string"), F.lit(", Exampleton - 411 0"), pad(n % 90, 2), F.lit(", Example State, India")))
    shapes = {
        "PERSON": fake_name(n),
        "EMAIL": F.concat(F.lit("user"), n.cast("string"), F.lit("@example.com")),
        "PHONE": F.concat(F.lit("+91 90"), pad(n, 8)),
        "COMPANY": F.concat_ws(" ", F.element_at(last, (n % len(L.LAST_NAMES) + 1).cast("int")), F.element_at(forms, (n % 6 + 1).cast("int"))),
        "ADDRESS": address,
        "SSN": F.concat_ws("-", pad(100 + n % 800, 3), pad(10 + n % 89, 2), pad(1000 + n % 8999, 4)),
        "CREDIT_CARD": F.lit("4111-1111-1111-1111"),
        "IP_ADDRESS": F.concat(F.lit("192.0.2."), (n % 254 + 1).cast("string")),
        "DOB": F.concat(pad(n % 28 + 1, 2), F.lit(" January 1990")),
        "PAN": F.lit("ABCDE1234F"),
        "DIN": (90000000 + n).cast("string"),
    }
    out = F.concat(F.lit("[REDACTED-"), type_, F.lit("-"), n.cast("string"), F.lit("]"))
    for name, value in shapes.items():
        out = F.when(type_ == name, value).otherwise(out)
    return out


def similar(a: str, b: str) -> bool:
    return a == b or difflib.SequenceMatcher(None, a, b).ratio() >= L.SIMILAR


def name_matches_local(name: str, local: str) -> bool:
    """Two words of a name, longer than two letters, closely resemble words of an e-mail's local part."""
    parts = [t for t in re.split("[^a-z]+", local.lower()) if t]
    return sum(any(similar(w, p) for p in parts) for w in name.lower().split() if len(w) > 2) >= 2


@F.pandas_udf(BooleanType())
def _matches(name: pd.Series, local: pd.Series) -> pd.Series:
    return pd.Series([name_matches_local(a, b) for a, b in zip(name, local, strict=True)])


def email_links(ids: DataFrame) -> DataFrame:
    """``doc_id, type, key, ctx, person_fake``: the first person seen before an e-mail whose name its local part resembles."""
    ship(ids.sparkSession)
    people = ids.where("type = 'PERSON'").select("doc_id", F.col("key").alias("name"), F.struct("first_unit", (-F.col("first_start")).alias("b")).alias("p_at"), "fake", "n")
    # one row a name before an e-mail: order by the name's first sight, value of its latest identity before the e-mail
    mails = ids.where("type = 'EMAIL'").select("doc_id", "type", "key", "ctx", F.struct("first_unit", (-F.col("first_start")).alias("b")).alias("m_at"))
    met = mails.join(people, "doc_id").where("p_at < m_at").where(_matches("name", F.substring_index("key", "@", 1)))
    per_name = met.groupBy("doc_id", "type", "key", "ctx", "name").agg(F.min("p_at").alias("first"), F.max_by("fake", "n").alias("fake"))
    return per_name.groupBy("doc_id", "type", "key", "ctx").agg(F.min_by("fake", "first").alias("person_fake"))


def email_of(name: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(name, "[^A-Za-z ]", ""), r"\s+"), lambda w: w != "")
    slug = F.array_join(F.transform(F.slice(words, 1, 2), F.lower), ".")
    return F.concat(F.when(slug == "", F.lit("user")).otherwise(slug), F.lit("@example.com"))


#: The seed by which the first identity gets the first stand-in; another one begins further on, so stand-ins stay distinct.
SEED = 42


def surrogates(ents: DataFrame, link_emails: bool = True, seed: int = SEED) -> DataFrame:
    """Ordinals with each identity's ``fake``."""
    ids = ordinals(ents).withColumn("fake", fake(F.col("type"), F.col("n") + (seed - SEED) % 1000, F.col("first_seen")))
    if not link_emails:
        return ids
    linked = ids.join(email_links(ids), ["doc_id", "type", "key", "ctx"], "left")
    return linked.withColumn("fake", F.when(F.col("person_fake").isNotNull(), email_of(F.col("person_fake"))).otherwise(F.col("fake"))).drop("person_fake")


def mapping(ids: DataFrame) -> DataFrame:
    """``doc_id, mapping``: first spelling to stand-in, by document."""
    label = F.concat(F.col("type"), F.lit(":"), F.col("first_seen"), F.when(F.col("ctx") != "", F.concat(F.lit(" ["), F.col("ctx"), F.lit("]"))).otherwise(""))
    return ids.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(label.alias("k"), F.col("fake").alias("v"))))).alias("mapping"))


def rewrite(detected: DataFrame, ents: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, unit, text, redacted``: each unit with its entities replaced; the gaps stay as they are.

    ``ents`` are the entities of ``detected``; the texts of units without any stay where they are.
    """
    ctx = F.coalesce(F.when(F.col("type") == "PERSON", F.col("ctx")), F.lit("")) if "ctx" in ents.columns else F.lit("")
    mention = ents.select("doc_id", "unit", "start", "end", "type", key_of(F.col("type"), F.col("text")).alias("key"), ctx.alias("ctx"))
    put = mention.join(ids.select("doc_id", "type", "key", "ctx", "fake"), ["doc_id", "type", "key", "ctx"])
    cuts = put.groupBy("doc_id", "unit").agg(F.array_sort(F.collect_list(F.struct("start", "end", "fake"))).alias("cuts"))
    text = F.col("text")

    def filled(gap) -> Column:
        """The gaps before the cuts, each with its stand-in, then the rest: joined once."""
        last = F.element_at("cuts", -1)["end"]
        pieces = F.transform("cuts", lambda c, i: F.concat(gap(F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1)["end"]), c["start"]), c["fake"]))
        return F.concat(F.array_join(pieces, ""), gap(last, F.length(text)))

    # offsets are bytes too where all characters are ASCII, and bytes are cut without counting from the text's start
    data = text.cast("binary")
    ascii_ = F.octet_length(text) == F.length(text)
    fold = F.when(ascii_, filled(lambda a, b: F.substring(data, a + 1, b - a).cast("string"))).otherwise(filled(lambda a, b: F.substring(text, a + 1, b - a)))
    plain = detected.where("coalesce(size(ents), 0) <= 0").select("doc_id", "unit", "text", text.alias("redacted"))
    units = detected.where("size(ents) > 0").select("doc_id", "unit", "text").join(cuts, ["doc_id", "unit"], "left")
    return plain.unionByName(units.select("doc_id", "unit", "text", F.when(F.col("cuts").isNull(), text).otherwise(fold).alias("redacted")))
