"""Queries of single operators over texts made from the keys of the relational tables, with DuckDB SQL that states what must come out.

Each text, name or label is picked by the key, so every row of a table is a case and the expected value is a function of the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.spans import ENTITY, entity, numbered, piece
from ..functions import lexicons as L
from ..functions.stage import materialize
from ..operators import blocks, detect, evaluate, identity, names, overlap, propagate, surrogates


def keys(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("k"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir, "customer", "c_custkey")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir, "orders", "o_orderkey")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir, "supplier", "s_suppkey")


CUSTOMERS, ORDERS, SUPPLIERS = "(SELECT c_custkey::bigint AS k FROM customer)", "(SELECT o_orderkey::bigint AS k FROM orders)", "(SELECT s_suppkey::bigint AS k FROM supplier)"


def pick(values: list, by: str = "k") -> Column:
    """The value at the key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(by) % len(values) + 1).cast("int"))


def pick_sql(values: list, by: str = "k") -> str:
    shown = ", ".join(str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{shown}][({by}) % {len(values)} + 1]"


#: Words before a match, and whether they say that it is something else. The seventh stands further away than the look-back.
FAR = "Invoice" + " " * 45
GUARDED = {
    "SSN": (["Invoice no: ", "ref #", "SSN: ", "Claim number ", "policyholder ", "Case closed. ", FAR], [True, True, False, True, False, False, False]),
    "CREDIT_CARD": (["qty ", "card ", "Account No. ", "transaction id: ", "paid by ", "units sold ", FAR], [True, False, True, True, False, False, False]),
    "IP_ADDRESS": (["Version ", "v ", "server ", "Section: ", "address ", "rebuild ", FAR], [True, True, False, True, False, False, False]),
}


def guard_rejections(spark, sf_dir):
    rows = orders(spark, sf_dir)
    out = [rows.select("k", F.lit(t).alias("type"), detect.guarded(t, pick(words), F.length(pick(words))).alias("rejected")) for t, (words, _) in GUARDED.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def resolve_overlaps(spark, sf_dir):
    """An e-mail, a person and a company whose places shift against each other."""
    made = [entity(F.lit(t), t, F.col("k") % m, F.col("k") % m + n, "case") for t, m, n in (("COMPANY", 23, 5), ("EMAIL", 10, 8), ("PERSON", 17, 6))]
    kept = orders(spark, sf_dir).select("k", F.explode(overlap.resolve(numbered(F.array(*made)))).alias("e"))
    return kept.select("k", F.col("e.type").alias("type"), F.col("e.start").cast("long").alias("start"))


#: What follows a postcode, and how much of it belongs to the address.
STREET = "12 Mill Lane, Pune - 411 001"
TAILS = [(", Maharashtra, India", 20), (" Phone 12", 0), (" Email: x", 0), (", Goa Website: y", 5), ("", 0), (" Alpha Beta Gamma Delta", 17), (" next", 0), (", Kerala: x", 0)]


def address_tail(spark, sf_dir):
    text = F.concat(F.lit(STREET), pick([t for t, _ in TAILS]))
    return customers(spark, sf_dir).select("k", piece(text, F.lit(0), detect.address_tail(text, F.lit(len(STREET)))).alias("address"))


#: Words before a postcode, and whether it is one.
BEFORE_CODE = [("Order ", False), ("Pune - ", True), ("PIN code: ", False), ("INZ-", False), ("inz-", True), ("Registration No: ", False), ("Mill Lane, ", True), ("Licence ", False)]


def address_guards(spark, sf_dir):
    text = pick([t for t, _ in BEFORE_CODE])
    return customers(spark, sf_dir).select("k", detect.postcode_valid(F.concat(text, F.lit("411001")), F.length(text)).alias("valid"))


def lines(df: DataFrame, *texts: Column) -> DataFrame:
    """Units of one document a key: a line each."""
    return df.select(F.col("k").alias("doc_id"), F.posexplode(F.array(*texts)).alias("unit", "text"))


def found(detected: DataFrame, *fields: str) -> DataFrame:
    e = detect.entities(detected).select("doc_id", F.col("unit").cast("long").alias("unit"), "type", "text", F.col("start").cast("long").alias("start"))
    return e.select("doc_id", *fields)


def address_multiline(spark, sf_dir):
    number = (F.col("k") % 1000).cast("string")
    code = F.concat(F.lit("  Pune - 4"), F.lpad((F.col("k") % 100).cast("string"), 2, "0"), F.lit(" 0"), F.lpad((F.col("k") % 100).cast("string"), 2, "0"))
    of = lines(customers(spark, sf_dir), F.concat(number, F.lit(" Mill Lane, Block B")), code, F.lit("Maharashtra, India"), F.lit("Status: open"))
    return found(blocks.stitch(detect.detect(of)), "unit", "type", "text", "start")


FIRST, SECOND = ["Asha Kelby", "Bela Lorne", "Charu Norwell"], ["Farid Oakham", "Gita Jessop"]


def contact_persons(spark, sf_dir):
    text = F.concat(F.lit("Contact Person: "), pick(FIRST), pick([" / ", " and "]), pick(SECOND), F.lit(", investor desk Email: a@b.org"))
    return customers(spark, sf_dir).select("k", F.explode(detect.contact_entities(text)).alias("e")).select("k", F.col("e.text").alias("name"), F.col("e.start").cast("long").alias("start"))


def split_person_list(spark, sf_dir):
    text = F.concat(pick(FIRST), F.lit(" / "), pick(SECOND))
    of = customers(spark, sf_dir).select("k", entity(text, "PERSON", F.col("k"), F.col("k") + F.length(text), "ner").alias("e"))
    return of.select("k", F.explode(detect.split_people(F.col("e"))).alias("e")).select("k", F.col("e.text").alias("name"), F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"))


PEOPLE = [("Asha Kelby", True), ("asha kelby", False), ("Asha", False), ("Mill Lane", False), ("Kelby Holdings", False), ("Asha 2nd", False), ("A B C D E F G", False), ("Équipe Nord", True), ("Annual Report", False)]
COMPANIES = [("Amber Valley Foods Limited", True), ("Limited", False), ("Pvt Ltd", False), ("Annual Report Limited", False), ("Equity Shares Limited", False), ("Amber Valley", False), ("Calder & Co", True), ("AB Ltd", False)]
LEADING = [("the Amber Foods Ltd", "Amber Foods Ltd"), ("Amber  Foods Ltd", "Amber Foods Ltd"), ("and by Registrar Calder LLP", "Calder LLP"), ("of the", ""), ("formerly Brook The Foods Ltd", "Brook The Foods Ltd"), ("von Amber AG", "Amber AG")]


def plausible_person(spark, sf_dir):
    return customers(spark, sf_dir).select("k", P.plausible_person(pick([n for n, _ in PEOPLE])).alias("plausible"))


def plausible_company(spark, sf_dir):
    return customers(spark, sf_dir).select("k", P.plausible_company(pick([n for n, _ in COMPANIES])).alias("plausible"))


def clean_company_span(spark, sf_dir):
    return customers(spark, sf_dir).select("k", P.clean_company(pick([n for n, _ in LEADING])).alias("name"))


FIRMS = ["Amber Valley Foods Limited", "Brook Valley Foods Limited", "Calder Valley Foods Limited"]


def told(spark, sf_dir) -> DataFrame:
    """A company said once in its own spelling and once in capitals, which no rule finds."""
    return detect.detect(lines(customers(spark, sf_dir), F.concat(F.lit("supplied by "), pick(FIRMS)), F.concat(F.lit("we met "), F.upper(pick(FIRMS)), F.lit(" again"))))


def vocabulary(spark, sf_dir):
    return propagate.vocabulary(told(spark, sf_dir))


def propagate_known(spark, sf_dir):
    return found(propagate.propagate(told(spark, sf_dir)), "unit", "type", "text", "start")


def ner_gazetteer(spark, sf_dir):
    names = spark.createDataFrame([(FIRST[0], "PERSON"), (FIRST[1], "PERSON"), ("Brook Valley", "COMPANY")], "value string, type string")
    of = lines(customers(spark, sf_dir), F.concat(F.lit("Yesterday "), pick([*FIRST, "BROOK VALLEY"]), F.lit(" met us")))
    return found(propagate.gazetteer(detect.detect(of), names), "unit", "type", "text", "start")


def all_names(spark: SparkSession) -> DataFrame:
    """Every first name with every last name, as a provider's list."""
    return spark.createDataFrame([(f"{a} {b}", "PERSON") for a in L.FIRST_NAMES for b in L.LAST_NAMES], "value string, type string")


def provided_identities(spark, sf_dir):
    """A name that a provider finds three times and propagation a fourth time, within a word; every third key says it of two people."""
    name = F.concat_ws(" ", pick(L.FIRST_NAMES), pick(L.LAST_NAMES, "k div 20"))
    role = F.when(F.col("k") % 3 == 0, F.lit("Treasurer")).otherwise(F.lit("Director"))
    of = lines(customers(spark, sf_dir), F.concat(F.lit("met "), name, F.lit(", Director, today")), F.concat(name, F.lit(", "), role, F.lit(", wrote")), F.concat(F.lit("then "), name, F.lit(" rang")), F.concat(F.lit("on "), name, F.lit("s, "), role, F.lit(", again")))
    # written step by step, as the whole run does
    rules = materialize(detect.detect(of, resolved=False), "rules")
    named = materialize(names.with_names(rules, names.of_names(all_names(spark))), "detected")
    people = materialize(propagate.propagate(named), "propagated")
    e = identity.resolve_identities(detect.entities(people))
    return e.select("doc_id", F.col("unit").cast("long").alias("unit"), "text", F.col("start").cast("long").alias("start"), "source", "ctx")


def carrier_cells(spark, sf_dir):
    """A provider that sees names only within a sentence, on cells of a name, of a role, and on lines too long for a second try."""
    name = F.concat_ws(" ", pick(L.FIRST_NAMES), pick(L.LAST_NAMES, "k div 20"))
    of = lines(customers(spark, sf_dir), name, F.lit("Managing Director"), F.concat(name, F.lit(" " + "x" * 60)))
    known = names.of_names(all_names(spark))

    def model(asked: DataFrame) -> DataFrame:
        return known(asked.where(F.startswith(F.col("text"), F.lit("Contact person: "))))

    e = names.provided(of, model)
    return e.select("doc_id", F.col("unit").cast("long").alias("unit"), F.col("e.text").alias("text"), F.col("e.start").cast("long").alias("start"))


#: Words before a name, after it, and the role and company that they give it.
SAID = [("", ", CFO, signed", "chief financial officer", ""), ("Director ", " signed", "director", ""), ("", ", Managing Director at Amber Valley Foods Limited", "managing director", "amber valley foods limited"), ("", " signed", "", ""), ("", ", Director & Partner", "director & partner", "")]


def person_context(spark, sf_dir):
    left, right = pick([s[0] for s in SAID]), pick([s[1] for s in SAID])
    start = F.length(left)
    role, org = P.person_context(F.concat(left, pick(FIRST), right), start, start + F.length(pick(FIRST)))
    return customers(spark, sf_dir).select("k", role.alias("role"), org.alias("org"))


ROLES, ORGS = ["director", "managing director", "treasurer", ""], ["amber ltd", "brook ltd", ""]


def context_conflict(spark, sf_dir):
    return orders(spark, sf_dir).select("k", P.contexts_conflict(pick(ROLES), pick(ORGS, "k div 4"), pick(ROLES, "k div 12"), pick(ORGS, "k div 48")).alias("conflict"))


def mentions(spark, sf_dir) -> DataFrame:
    """Three mentions of one name: a director, then one of three roles, then no role."""
    second = F.when(F.col("k") % 3 == 0, F.lit("managing director")).when(F.col("k") % 3 == 1, F.lit("treasurer"))
    roles = F.array(F.lit("director"), second, F.lit(None).cast("string"))
    of = customers(spark, sf_dir).select(F.col("k").alias("doc_id"), F.posexplode(roles).alias("unit", "said"))
    e = entity(F.lit("Asha Kelby"), "PERSON", F.lit(0), F.lit(10), "case", F.col("said"), F.when(F.col("said").isNotNull(), F.lit("")))
    return of.select("doc_id", "unit", e.cast(ENTITY).alias("e")).select("doc_id", "unit", "e.*")


def identity_clusters(spark, sf_dir):
    return identity.clusters(mentions(spark, sf_dir)).select("doc_id", "name", F.posexplode("groups").alias("group", "g")).select("doc_id", "name", F.col("group").cast("long").alias("group"), "g.role", "g.org")


def identity_resolution(spark, sf_dir):
    return identity.resolve_identities(mentions(spark, sf_dir)).select("doc_id", F.col("unit").cast("long").alias("unit"), "ctx")


def email_person_link(spark, sf_dir):
    of = lines(suppliers(spark, sf_dir), F.lit("Contact Person: Asha Kelby"), F.concat(F.lit("Write to "), pick(["asha.kelby", "info", "kelbi_ashaa"]), F.lit("@corp.org")))
    ids = surrogates.surrogates(identity.resolve_identities(detect.entities(detect.detect(of))))
    return ids.where("type = 'EMAIL'").select("doc_id", "key", "fake")


def items(df: DataFrame, corpus: Column, ord_: Column, text: Column, type_: str) -> DataFrame:
    return df.select(corpus.alias("corpus"), ord_.alias("ord"), text.alias("text"), F.lit(type_).alias("type"))


def eval_dedupe(spark, sf_dir):
    """Spellings of one company a hundred orders: the first is kept."""
    text = F.concat(pick(["Amber ", " amber  ", "(AMBER "]), F.expr("k div 100").cast("string"), pick(["", ".", ")"]))
    return evaluate.dedupe(items(orders(spark, sf_dir), F.lit("orders"), F.col("k"), text, "COMPANY")).select("ord", "text", "key")


def eval_phone(spark, sf_dir):
    number = F.lpad(F.col("k").cast("string"), 8, "0")
    c = customers(spark, sf_dir)
    truth = items(c, F.lit("customers"), F.col("k"), F.concat(F.lit("+91 90"), number), "PHONE")
    said = items(c.where("k % 4 <> 0"), F.lit("customers"), F.col("k"), F.concat(F.lit("+91-(90) "), number), "PHONE")
    return evaluate.outcomes(said, truth).select("text", "outcome")


def eval_address(spark, sf_dir):
    """Two fragments that meet one annotation, a stranger, and annotations that nothing meets."""
    c, corpus, number = customers(spark, sf_dir), F.col("k").cast("string"), F.col("k").cast("string")
    truth = items(c, corpus, F.lit(0), F.concat(number, F.lit(" Mill Lane, Pune – 411 001")), "ADDRESS")
    some = c.where("k % 5 <> 0")
    parts = [items(some, corpus, F.lit(0), F.concat(number, F.lit(" MILL lane,")), "ADDRESS"), items(some, corpus, F.lit(1), F.lit("Pune - 411 001"), "ADDRESS"), items(c.where("k % 3 = 0"), corpus, F.lit(2), F.lit("Goa 403 001"), "ADDRESS")]
    return evaluate.outcomes(parts[0].unionByName(parts[1]).unionByName(parts[2]), truth).select("corpus", "text", "outcome")


def eval_scope(spark, sf_dir):
    scope = spark.createDataFrame([("a", 3, 9), ("b", 0, 0)], "corpus string, unit_start int, unit_end int")
    rows = customers(spark, sf_dir).select("k", pick(["a", "b", "c"]).alias("corpus"), (F.col("k") % 16).cast("int").alias("unit"))
    return evaluate.in_scope(rows, scope).select("k")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (guard_rejections, resolve_overlaps, address_tail, address_guards, address_multiline, contact_persons, split_person_list, plausible_person, plausible_company, clean_company_span, vocabulary, propagate_known, ner_gazetteer, provided_identities, carrier_cells, person_context, context_conflict, identity_clusters, identity_resolution, email_person_link, eval_dedupe, eval_phone, eval_address, eval_scope)}


def oracle_sql() -> dict[str, str]:
    first, second, firm = pick_sql(FIRST), pick_sql(SECOND), pick_sql(FIRMS)
    a, b = pick_sql(ROLES), pick_sql(ROLES, "k // 12")
    x, y = pick_sql(ORGS, "k // 4"), pick_sql(ORGS, "k // 48")
    return {
        "guard_rejections": " UNION ALL ".join(f"SELECT k, '{t}' AS type, {pick_sql(said)} AS rejected FROM {ORDERS}" for t, (_, said) in GUARDED.items()),
        "resolve_overlaps": f"""
            WITH p AS (SELECT k, k % 10 AS m, k % 17 AS p, k % 23 AS c FROM {ORDERS}),
            q AS (SELECT *, NOT (p < m + 8 AND m < p + 6) AS keep_p FROM p)
            SELECT k, 'EMAIL' AS type, m AS start FROM q
            UNION ALL SELECT k, 'PERSON', p FROM q WHERE keep_p
            UNION ALL SELECT k, 'COMPANY', c FROM q WHERE NOT (c < m + 8 AND m < c + 5) AND NOT (keep_p AND c < p + 6 AND p < c + 5)""",
        "address_tail": f"SELECT k, '{STREET}' || substr({pick_sql([t for t, _ in TAILS])}, 1, {pick_sql([n for _, n in TAILS])}) AS address FROM {CUSTOMERS}",
        "address_guards": f"SELECT k, {pick_sql([ok for _, ok in BEFORE_CODE])} AS valid FROM {CUSTOMERS}",
        "address_multiline": f"""
            WITH d AS (SELECT k, lpad((k % 100)::varchar, 2, '0') AS p FROM {CUSTOMERS})
            SELECT k AS doc_id, 0::bigint AS unit, 'ADDRESS' AS type, (k % 1000) || ' Mill Lane, Block B' AS text, 0::bigint AS start FROM d
            UNION ALL SELECT k, 1, 'ADDRESS', 'Pune - 4' || p || ' 0' || p, 2 FROM d
            UNION ALL SELECT k, 2, 'ADDRESS', 'Maharashtra, India', 0 FROM d""",
        "contact_persons": f"""
            SELECT k, {first} AS name, 16::bigint AS start FROM {CUSTOMERS}
            UNION ALL SELECT k, {second}, 16 + length({first}) + length({pick_sql([" / ", " and "])}) FROM {CUSTOMERS}""",
        "split_person_list": f"""
            SELECT k, {first} AS name, k AS start, k + length({first}) AS "end" FROM {CUSTOMERS}
            UNION ALL SELECT k, {second}, k + length({first}) + 3, k + length({first}) + 3 + length({second}) FROM {CUSTOMERS}""",
        "plausible_person": f"SELECT k, {pick_sql([ok for _, ok in PEOPLE])} AS plausible FROM {CUSTOMERS}",
        "plausible_company": f"SELECT k, {pick_sql([ok for _, ok in COMPANIES])} AS plausible FROM {CUSTOMERS}",
        "clean_company_span": f"SELECT k, {pick_sql([n for _, n in LEADING])} AS name FROM {CUSTOMERS}",
        "vocabulary": f"SELECT k AS doc_id, {firm} AS value, 'COMPANY' AS type FROM {CUSTOMERS}",
        "propagate_known": f"""
            SELECT k AS doc_id, 0::bigint AS unit, 'COMPANY' AS type, {firm} AS text, 12::bigint AS start FROM {CUSTOMERS}
            UNION ALL SELECT k, 1, 'COMPANY', upper({firm}), 7 FROM {CUSTOMERS}""",
        "ner_gazetteer": f"SELECT k AS doc_id, 0::bigint AS unit, {pick_sql(['PERSON', 'PERSON', '', 'COMPANY'])} AS type, {pick_sql([*FIRST, 'BROOK VALLEY'])} AS text, 10::bigint AS start FROM {CUSTOMERS} WHERE k % 4 <> 2",
        "provided_identities": f"""
            WITH n AS (SELECT k, {pick_sql(L.FIRST_NAMES)} || ' ' || {pick_sql(L.LAST_NAMES, "k // 20")} AS name FROM {CUSTOMERS})
            SELECT k AS doc_id, unit, name AS text, start, source, CASE WHEN k % 3 = 0 THEN ctx END AS ctx
            FROM n, (VALUES (0::bigint, 4::bigint, 'ner', '#0'), (1, 0, 'ner', '#1'), (2, 5, 'ner', '#0'), (3, 3, 'propagated', '#1')) u(unit, start, source, ctx)""",
        "carrier_cells": f"SELECT k AS doc_id, 0::bigint AS unit, {pick_sql(L.FIRST_NAMES)} || ' ' || {pick_sql(L.LAST_NAMES, 'k // 20')} AS text, 0::bigint AS start FROM {CUSTOMERS}",
        "person_context": f"SELECT k, {pick_sql([s[2] for s in SAID])} AS role, {pick_sql([s[3] for s in SAID])} AS org FROM {CUSTOMERS}",
        "context_conflict": f"""
            WITH c AS (SELECT k, {a} AS a, {b} AS b, {x} AS x, {y} AS y FROM {ORDERS})
            SELECT k, a <> '' AND b <> '' AND (NOT (contains(a, b) OR contains(b, a)) OR (x <> '' AND y <> '' AND x <> y)) AS conflict FROM c""",
        "identity_clusters": f"""
            SELECT k AS doc_id, 'asha kelby' AS name, 0::bigint AS "group", 'director' AS role, '' AS org FROM {CUSTOMERS}
            UNION ALL SELECT k, 'asha kelby', 1, 'treasurer', '' FROM {CUSTOMERS} WHERE k % 3 = 1""",
        "identity_resolution": f"SELECT k AS doc_id, unit, CASE WHEN k % 3 = 1 THEN CASE WHEN unit = 1 THEN '#1' ELSE '#0' END END AS ctx FROM {CUSTOMERS}, (VALUES (0::bigint), (1), (2)) u(unit)",
        "email_person_link": f"SELECT k AS doc_id, {pick_sql(['asha.kelby', 'info', 'kelbi_ashaa'])} || '@corp.org' AS key, CASE WHEN k % 3 = 1 THEN 'user1' ELSE 'bela.brookfen' END || '@example.com' AS fake FROM {SUPPLIERS}",
        "eval_dedupe": f"""
            WITH i AS (SELECT k, {pick_sql(["Amber ", " amber  ", "(AMBER "])} || (k // 100) || {pick_sql(["", ".", ")"])} AS text, 'amber ' || (k // 100) AS key FROM {ORDERS})
            SELECT min(k) AS ord, arg_min(text, k) AS text, key FROM i GROUP BY key""",
        "eval_phone": f"SELECT '+91 90' || lpad(k::varchar, 8, '0') AS text, CASE WHEN k % 4 = 0 THEN 'fn' ELSE 'tp' END AS outcome FROM {CUSTOMERS}",
        "eval_address": f"""
            SELECT k::varchar AS corpus, k || ' Mill Lane, Pune – 411 001' AS text, CASE WHEN k % 5 = 0 THEN 'fn' ELSE 'tp' END AS outcome FROM {CUSTOMERS}
            UNION ALL SELECT k::varchar, 'Goa 403 001', 'fp' FROM {CUSTOMERS} WHERE k % 3 = 0""",
        "eval_scope": f"SELECT k FROM {CUSTOMERS} WHERE (k % 3 = 0 AND k % 16 BETWEEN 3 AND 9) OR (k % 3 = 1 AND k % 16 = 0)",
    }
