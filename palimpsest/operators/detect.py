"""Detectors: from a unit's text to an array of entities, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import predicates as P
from ..functions.spans import CLOSE, ENTITY, INNER, OPEN, SPAN, before, empty, entity, find, numbered, once, piece

RULES = {"EMAIL": L.EMAIL, "PHONE": "(?U)" + L.PHONE, "SSN": L.SSN, "CREDIT_CARD": L.CREDIT_CARD, "IP_ADDRESS": L.IP_ADDRESS, "PAN": L.PAN, "DIN": L.DIN}


#: What every match of a rule contains; a search for it is much cheaper than the rule.
GATES = {"EMAIL": "@", "PHONE": r"(?U)\+\s?\d", "SSN": r"\d-\d\d-\d", "CREDIT_CARD": r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d", "IP_ADDRESS": r"\d\.\d", "PAN": r"[A-Z]{5}\d", "DIN": r"\d{8}"}


def guarded(type_: str, text: Column, start: Column) -> Column:
    """Whether the words before a match say that it is something else."""
    return before(text, start, L.LOOK_BACK).rlike(L.GUARDS[type_]) if type_ in L.GUARDS else F.lit(False)


def pattern_entities(text: Column, type_: str) -> Column:
    """Entities of one structured type."""
    marked = f"$1{OPEN}$2{CLOSE}" if type_ == "DIN" else f"{OPEN}$0{CLOSE}"
    spans = find(text, RULES[type_], marked, text.rlike(GATES[type_]))
    if type_ == "CREDIT_CARD":
        spans = F.filter(spans, lambda s: P.luhn_valid(s["text"]))
    if type_ in L.GUARDS:
        spans = F.filter(spans, lambda s: ~guarded(type_, text, s["start"]))
    return F.transform(spans, lambda s: entity(s["text"], type_, s["start"], s["end"], "regex"))


def dob_entities(text: Column) -> Column:
    """Every date of a unit that has a birth word."""
    dates = F.concat(*(find(text, d) for d in L.DATES))
    return F.when(text.rlike(L.BIRTH_GATE), F.transform(dates, lambda s: entity(s["text"], "DOB", s["start"], s["end"], "regex"))).otherwise(empty(ENTITY))


def postcode_valid(text: Column, at: Column) -> Column:
    ok = F.lit(True)
    for p in L.NOT_POSTCODE:
        ok &= ~before(text, at, L.LOOK_BACK).rlike(p)
    return ok


def address_tail(text: Column, end: Column) -> Column:
    """The end of an address whose postcode ends at ``end``: up to three capitalised words more."""
    stop = F.array(*map(F.lit, L.TAIL_STOP_WORDS))

    def step(acc, _):
        rest = F.substring(text, acc["pos"] + 1, F.length(text))
        took, word = F.regexp_extract(rest, L.TAIL_TOKEN, 1), F.regexp_extract(rest, L.TAIL_TOKEN, 2)
        after = acc["pos"] + F.length(took)
        ok = acc["go"] & (took != "") & ~F.array_contains(stop, F.lower(F.btrim(word, F.lit(".")))) & (F.substring(text, after + 1, F.lit(1)) != ":")
        return F.struct(F.when(ok, after).otherwise(acc["pos"]).alias("pos"), ok.alias("go"))

    start = F.struct(end.cast("int").alias("pos"), F.lit(True).alias("go"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(L.TAIL_TOKENS)), start, step, lambda a: a["pos"])


def address_entities(text: Column) -> Column:
    """Single-line postal addresses: a street line up to a postcode, its tail, without a form label before it."""
    spans = F.filter(find(text, L.ADDRESS, f"{OPEN}$1{INNER}$2{CLOSE}", text.rlike("[0-9]") & text.rlike(L.POSTCODE)), lambda s: postcode_valid(text, s["mark"]))

    def trimmed(s):
        end = address_tail(text, s["end"])
        raw = piece(text, s["start"], end)
        start = s["start"] + F.length(F.regexp_extract(raw, L.ADDRESS_LABEL, 0))
        value = F.rtrim(piece(text, start, end), F.lit(" .,;:-–—"))
        return entity(value, "ADDRESS", start, start + F.length(value), "rule")

    return F.filter(F.transform(spans, trimmed), lambda e: F.contains(e["text"], F.lit(",")))


def contact_entities(text: Column) -> Column:
    """People listed after a contact-person label."""
    tail = F.regexp_extract(text, L.CONTACT_PERSON, 1)
    whole = F.regexp_extract(text, L.CONTACT_PERSON, 0)
    start = F.call_function("locate", whole, text) - 1 + F.length(whole) - F.length(tail)
    cut = F.element_at(F.split(tail, L.CONTACT_CUT, 2), 1)
    names = F.filter(F.split(cut, L.NAME_SEPARATOR), lambda x: F.trim(x) != "")
    # offsets: names are parts of the cut tail in order, so each is found from the end of the one before
    folded = F.aggregate(
        names,
        F.struct(F.lit(0).alias("pos"), empty(SPAN).alias("out")),
        lambda acc, part: F.struct(
            (F.call_function("locate", F.trim(part), cut, acc["pos"] + 1) - 1 + F.length(F.trim(part))).cast("int").alias("pos"),
            F.concat(acc["out"], F.array(F.struct(F.trim(part).alias("text"), (F.call_function("locate", F.trim(part), cut, acc["pos"] + 1) - 1).cast("int").alias("start"), (F.call_function("locate", F.trim(part), cut, acc["pos"] + 1) - 1 + F.length(F.trim(part))).cast("int").alias("end"), F.lit(None).cast("int").alias("mark")).cast(SPAN))).alias("out"),
        ),
        lambda acc: acc["out"],
    )

    def person(s):
        a, b = start + s["start"], start + s["end"]
        role, org = P.person_context(text, a, b)
        said = (role != "") | (org != "")
        return entity(s["text"], "PERSON", a, b, "rule-contact", F.when(said, role), F.when(said, org))

    return F.when(text.rlike(L.CONTACT_PERSON), F.transform(F.filter(folded, lambda s: P.plausible_person(s["text"])), person)).otherwise(empty(ENTITY))


def legal_form(text: Column) -> Column:
    """Whether the letters of any legal form stand in the text: plain substring searches."""
    out = F.lit(False)
    for word in ("Limited", "Ltd", "LLP", "L.L.P.", "Inc", "Corp", "PLC", "GmbH", "N.V.", "S.A.", "Trust", "Bank", "Securities", "Technologies", "Industries"):
        out |= F.contains(text, F.lit(word))
    return out


def company_entities(text: Column) -> Column:
    """Names that end in a legal form."""

    def trimmed(s):
        value = P.clean_company(F.btrim(F.trim(s["text"]), F.lit(",;")))
        lead = F.length(s["text"]) - F.length(F.ltrim(s["text"]))
        start = F.greatest(F.call_function("locate", value, text, s["start"] + 1) - 1, s["start"] + lead)
        return entity(value, "COMPANY", start, start + F.length(value), "rule-company")

    found = F.transform(find(text, L.COMPANY, gate=legal_form(text)), trimmed)
    return F.filter(found, lambda e: (e["text"] != "") & ~F.lower(e["text"]).isin(*L.PUBLIC_BODIES) & P.plausible_company(e["text"]))


def split_people(e: Column) -> Column:
    """People of a span listed with slashes, with offsets of their own."""
    parts = find(e["text"], r"[^/]+")
    out = F.transform(parts, lambda s: entity(F.trim(s["text"]), "PERSON", e["start"] + s["start"] + F.length(s["text"]) - F.length(F.ltrim(s["text"])), e["start"] + s["start"] + F.length(s["text"]) - F.length(F.ltrim(s["text"])) + F.length(F.trim(s["text"])), "ner", e["role"], e["org"]))
    return F.when(F.contains(e["text"], F.lit("/")), F.filter(out, lambda x: x["text"] != "")).otherwise(F.array(e))


def rule_columns(text: Column) -> dict[str, Column]:
    """The rules in their order: structured types, dates of birth, addresses, contact lists, companies."""
    out = {f"_{t}": pattern_entities(text, t) for t in RULES}
    return out | {"_dob": dob_entities(text), "_address": address_entities(text), "_contact": contact_entities(text), "_company": company_entities(text)}


def detect(units: DataFrame, resolved: bool = True) -> DataFrame:
    """Units with their entities ``ents``, resolved or all that the rules found; narrow, no shuffle.

    The rules, their concatenation and the resolution are projections of their own, so that none is evaluated twice. Rules are
    tried only on units that any of them can match.
    """
    from .overlap import resolve

    rules = {name: F.when(F.col("_may"), found).otherwise(empty(ENTITY)) for name, found in rule_columns(F.col("text")).items()}
    found = units.withColumn("_may", once(may_hold(F.col("text")))).withColumns(rules)
    every = found.select(*units.columns, F.concat(*rules).alias("_all"))
    return every.select(*units.columns, numbered(F.col("_all")).alias("_all")).select(*units.columns, once(resolve(F.col("_all")) if resolved else F.col("_all")).alias("ents"))


def may_hold(text: Column) -> Column:
    """Whether any rule can match: phones need a plus sign, the others but the e-mail, contact and company rules a digit."""
    return text.rlike("[0-9@+]") | legal_form(text) | text.rlike(L.CONTACT_PERSON)


def detected_entities(units: DataFrame) -> DataFrame:
    """``entities`` of units, of which those that no rule can match leave before any rule runs."""
    return entities(detect(units.where(may_hold(F.col("text")))))


def entities(detected: DataFrame) -> DataFrame:
    """One row an entity: ``doc_id, unit`` and its fields."""
    return detected.where(F.size("ents") > 0).select("doc_id", "unit", F.explode("ents").alias("e")).select("doc_id", "unit", "e.*")
