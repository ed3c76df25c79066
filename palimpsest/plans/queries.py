"""The registered queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import luhn_valid
from ..functions.sql import register
from ..functions.stage import shared_folder
from ..operators import blocks, detect, evaluate, surrogates
from ..sources.units import spread, units
from . import cases, derived
from .pipeline import redact


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def all_units(spark, sf_dir) -> DataFrame:
    return units(corpus(spark, sf_dir))


#: Types that the corpus holds.
STRUCTURED = ("EMAIL", "CREDIT_CARD", "IP_ADDRESS", "PHONE")


def structured(spark, sf_dir) -> DataFrame:
    """Entities of all rules over the documents."""
    return detect.detected_entities(all_units(spark, sf_dir))


def of_type(type_: str):
    def query(spark, sf_dir):
        spans = detect.pattern_entities(F.col("text"), type_)
        return all_units(spark, sf_dir).select("doc_id", "unit", F.explode(spans).alias("e")).select("doc_id", "unit", F.col("e.text").alias("text"), F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"))

    return query


def units_from_documents(spark, sf_dir):
    return all_units(spark, sf_dir).select("doc_id", F.col("unit").cast("long").alias("unit"), "text")


def units_nonblank_count(spark, sf_dir):
    return all_units(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"))


def luhn_filter(spark, sf_dir):
    found = all_units(spark, sf_dir).select("doc_id", F.explode(F.expr(r"regexp_extract_all(text, '\\b\\d{16}\\b', 0)")).alias("number"))
    return found.where(luhn_valid(F.col("number")))


def spans_with_offsets(spark, sf_dir):
    e = structured(spark, sf_dir)
    return e.select("doc_id", F.col("unit").cast("long").alias("unit"), "type", "text", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def entity_counts_by_type(spark, sf_dir):
    return structured(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def entity_counts_by_lang(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return structured(spark, sf_dir).select("doc_id", "type").join(langs, "doc_id").groupBy("lang", "type").agg(F.count(F.lit(1)).alias("n"))


def entity_rollup(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = structured(spark, sf_dir).select("doc_id", "type").join(langs, "doc_id")
    return joined.rollup("type", "lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def pii_by_label(spark, sf_dir):
    per = structured(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    return table(spark, sf_dir, "labels").join(per, "doc_id", "left").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


def docs_with_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(structured(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")


def docs_without_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(structured(spark, sf_dir).select("doc_id"), "doc_id", "left_anti")


def top_docs_by_entities(spark, sf_dir):
    return structured(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


def surrogate_values(spark, sf_dir):
    ids = redact(corpus(spark, sf_dir)).surrogates
    return ids.select("doc_id", "type", "key", "n", "first_seen", F.col("first_unit").cast("long").alias("first_unit"), F.col("first_start").cast("long").alias("first_start"), "fake")


def mapping_report(spark, sf_dir):
    """First spellings and their stand-ins, as the mapping file lists them."""
    made = surrogates.mapping(redact(corpus(spark, sf_dir)).surrogates)
    return made.select("doc_id", F.explode("mapping").alias("label", "fake"))


def report_markdown(spark, sf_dir):
    return evaluate.report(derived.evaluation_metrics(spark, sf_dir))


def sql_functions(spark, sf_dir):
    """The documents' structured values found by the SQL functions of the session."""
    register(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("palimpsest_documents")
    # SQL functions can't stand within a generator: arrays first, then rows
    return spark.sql("""
        WITH f AS (SELECT doc_id, pii_emails(text) AS mails, pii_card_candidates(text) AS cards, pii_ip_candidates(text) AS ips FROM palimpsest_documents),
        v AS (SELECT doc_id, 'EMAIL' AS type, explode(mails) AS v FROM f UNION ALL SELECT doc_id, 'CREDIT_CARD', explode(cards) FROM f UNION ALL SELECT doc_id, 'IP_ADDRESS', explode(ips) FROM f)
        SELECT doc_id, type, CASE WHEN type = 'CREDIT_CARD' THEN pii_digits(v) ELSE pii_key(type, v) END AS value FROM v""")


def stream_redact_folder(spark, sf_dir):
    """The documents as a stream of files, rewritten as they arrive; what the stream wrote."""
    from ..streaming.folder import incoming, redact_stream

    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    redact_stream(incoming(spark, f"{sf_dir}/documents.parquet*"), f"{out}/redacted", f"{out}/progress").awaitTermination()
    return spark.read.schema("doc_id long, unit int, text string, redacted string").parquet(f"{out}/redacted/batch=*").select("doc_id", F.col("unit").cast("long").alias("unit"), "redacted")


def address_blocks(spark, sf_dir):
    made = blocks.blocks(detect.detect(all_units(spark, sf_dir)))
    return made.select("doc_id", F.get("members", F.lit(0))["unit"].cast("long").alias("first_unit"), F.size("members").cast("long").alias("n_units"))


def redacted_text(spark, sf_dir):
    return redact(corpus(spark, sf_dir)).redacted.select("doc_id", F.col("unit").cast("long").alias("unit"), "redacted")


def redacted_named(spark, sf_dir):
    """The whole run with a provider of names beside the rules: filter, carrier sentence, joint resolution, propagation, identities, links."""
    return redact(corpus(spark, sf_dir), cases.all_names(spark)).redacted.select("doc_id", F.col("unit").cast("long").alias("unit"), "redacted")


def redaction_summary(spark, sf_dir):
    return redact(corpus(spark, sf_dir)).summary()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (units_from_documents, units_nonblank_count, luhn_filter, spans_with_offsets, entity_counts_by_type, entity_counts_by_lang, entity_rollup, pii_by_label, docs_with_pii, docs_without_pii, top_docs_by_entities, surrogate_values, mapping_report, report_markdown, sql_functions, address_blocks, redacted_text, redacted_named, redaction_summary, stream_redact_folder)
    out = {f"detect_{t.lower()}": of_type(t) for t in STRUCTURED}
    return out | {f.__name__: f for f in own} | derived.queries() | cases.queries()


def _marked(column: str, pattern: str, replacement: str) -> str:
    """Matches with offsets: mark, split, and sum the lengths of what stands before."""
    return f"string_split_regex(regexp_replace({column}, '{pattern}', '{replacement}', 'g'), '[\ue000\ue001]')"


UNITS = r"""
    l AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\r\n|[\n\r\x0B\f]'), lambda x: regexp_matches(x, '\S'))) AS text,
                 generate_subscripts(list_filter(string_split_regex(text, '\r\n|[\n\r\x0B\f]'), lambda x: regexp_matches(x, '\S')), 1) - 1 AS unit FROM documents)"""
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PATTERNS = {
    "EMAIL": (r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", "\ue000\\1\ue001"),
    "CREDIT_CARD": (r"\b(([0-9][ -]?){12,18}[0-9])\b", "\ue000\\1\ue001"),
    "IP_ADDRESS": (rf"\b(({_OCTET}\.){{3}}{_OCTET})\b", "\ue000\\1\ue001"),
    "PHONE": (r"(^|[^\w.])(\+\s?[0-9]{1,3}[\s-]?[0-9(][0-9\s()-]{7,16}[0-9])", "\\1\ue000\\2\ue001"),
}
_RANK = {"EMAIL": 100, "CREDIT_CARD": 90, "IP_ADDRESS": 85, "PHONE": 80}


def _spans_sql(type_: str) -> str:
    pattern, replacement = _PATTERNS[type_]
    guard = {"CREDIT_CARD": r"(?i)\b(ticket|reference|ref|order|invoice|share|shares|unit|units|quantity|qty|account|folio|transaction|txn|id)\b[\s:#]*(no\.?|number|id)?[\s:#]*$", "IP_ADDRESS": r"(?i)\b(version|build|release|ver|v|revision|clause|section|rule|regulation)\b[\s:.#]*$"}.get(type_)
    where = ["i % 2 = 0"]
    if type_ == "CREDIT_CARD":
        d = "regexp_replace(span, '[^0-9]', '', 'g')"
        double = f"list_sum(list_transform(range(1, length({d}) + 1), lambda j: CASE WHEN (length({d}) - j) % 2 = 1 THEN CASE WHEN substr({d}, j::int, 1)::int > 4 THEN substr({d}, j::int, 1)::int * 2 - 9 ELSE substr({d}, j::int, 1)::int * 2 END ELSE substr({d}, j::int, 1)::int END))"
        where.append(f"length({d}) BETWEEN 13 AND 19 AND {double} % 10 = 0")
    if guard:
        where.append(f"NOT regexp_matches(substr(text, greatest(start - 39, 1)::int, least(start, 40)::int), '{guard}')")
    return f"""
        SELECT doc_id, unit, '{type_}' AS type, {_RANK[type_]} AS rank, span AS text, start, start + length(span) AS "end" FROM (
            SELECT doc_id, unit, text, i, parts[i] AS span, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0)::bigint AS start
            FROM (SELECT doc_id, unit, text, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, unit, text, {_marked("text", pattern, replacement)} AS parts FROM l WHERE regexp_matches(text, '{pattern}')))
        ) WHERE {" AND ".join(where)}"""


def _entities_sql() -> str:
    """The four types of the corpus, resolved: no entity overlaps one that ranks before it (chains don't occur between them)."""
    every = " UNION ALL ".join(map(_spans_sql, STRUCTURED))
    return f"""WITH {UNITS}, a AS ({every}),
        e AS (SELECT * FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE x.doc_id = y.doc_id AND x.unit = y.unit AND y.rank > x.rank AND x.start < y."end" AND y.start < x."end"))"""


def oracle_sql() -> dict[str, str]:
    e, digits = _entities_sql(), "regexp_replace(v, '[^0-9]', '', 'g')"
    out = {f"detect_{t.lower()}": f'WITH {UNITS} SELECT doc_id, unit, text, start, "end" FROM ({_spans_sql(t)})' for t in STRUCTURED}
    ordinal = """
        i AS (SELECT *, CASE WHEN type = 'PHONE' THEN regexp_replace(text, '[^0-9]', '', 'g') ELSE lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS key FROM e),
        f AS (SELECT doc_id, type, key, arg_min(text, (unit, -start)) AS first_seen, arg_min(unit, (unit, -start)) AS first_unit, arg_min(start, (unit, -start)) AS first_start FROM i GROUP BY ALL),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first_unit, first_start DESC) AS n FROM f),
        m AS (SELECT *, CASE type WHEN 'EMAIL' THEN 'user' || n || '@example.com' WHEN 'PHONE' THEN '+91 90' || lpad(n::varchar, 8, '0') WHEN 'CREDIT_CARD' THEN '4111-1111-1111-1111' ELSE '192.0.2.' || (n % 254 + 1) END AS fake FROM s)"""
    out |= derived.oracle_sql() | cases.oracle_sql() | {
        "units_from_documents": f"WITH {UNITS} SELECT doc_id, unit, text FROM l",
        "units_nonblank_count": f"WITH {UNITS} SELECT doc_id, count(*) AS n_units FROM l GROUP BY doc_id",
        "luhn_filter": f"WITH {UNITS}, n AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{{16}}\\b')) AS number FROM l) SELECT doc_id, number FROM n WHERE list_sum(list_transform(range(1, 17), lambda j: CASE WHEN j % 2 = 1 THEN CASE WHEN substr(number, j::int, 1)::int > 4 THEN substr(number, j::int, 1)::int * 2 - 9 ELSE substr(number, j::int, 1)::int * 2 END ELSE substr(number, j::int, 1)::int END)) % 10 = 0",
        "spans_with_offsets": f'{e} SELECT doc_id, unit, type, text, start, "end" FROM e',
        "entity_counts_by_type": f"{e} SELECT type, count(*) AS n FROM e GROUP BY type",
        "entity_counts_by_lang": f"{e} SELECT lang, type, count(*) AS n FROM e JOIN documents USING (doc_id) GROUP BY ALL",
        "entity_rollup": f"{e} SELECT type, lang, count(*) AS n, count(DISTINCT doc_id) AS docs FROM e JOIN documents USING (doc_id) GROUP BY ROLLUP (type, lang)",
        "pii_by_label": f"{e}, p AS (SELECT doc_id, count(*) AS k FROM e GROUP BY doc_id) SELECT quality, toxic, count(*) AS docs, coalesce(sum(k), 0)::bigint AS n FROM labels LEFT JOIN p USING (doc_id) GROUP BY quality, toxic",
        "docs_with_pii": f"{e} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM e)",
        "docs_without_pii": f"{e} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e)",
        "top_docs_by_entities": f"{e} SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 20",
        "surrogate_values": f"{e}, {ordinal} SELECT doc_id, type, key, n, first_seen, first_unit, first_start, fake FROM m",
        "redaction_summary": f"""{e}, {ordinal},
            n AS (SELECT doc_id, count(*) AS total FROM e GROUP BY doc_id), q AS (SELECT doc_id, count(*) AS kinds FROM m GROUP BY doc_id)
            SELECT doc_id, count(*) AS text_units, coalesce(any_value(total), 0) AS total_entities, coalesce(any_value(kinds), 0) AS unique_entities
            FROM l LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id) GROUP BY doc_id""",
        "mapping_report": f"{e}, {ordinal} SELECT doc_id, type || ':' || first_seen AS label, fake FROM m",
        "report_markdown": f"""
            WITH s AS ({derived.oracle_sql()["evaluation_metrics"]})
            SELECT corpus, '### Corpus: ' || corpus || chr(10) || chr(10) || '| PII Type | Precision | Recall | F1 | Accuracy | TP | FP | FN | Support |' || chr(10) || '|---|---|---|---|---|---|---|---|---|' || chr(10) ||
                string_agg(CASE WHEN type = 'ALL' THEN printf('| **OVERALL** | **%.2f** | **%.2f** | **%.2f** | **%.2f** | %d | %d | %d | %d |', precision, recall, f1, accuracy, tp, fp, fn, support)
                    ELSE printf('| %s | %.2f | %.2f | %.2f | %.2f | %d | %d | %d | %d |', type, precision, recall, f1, accuracy, tp, fp, fn, support) END, chr(10) ORDER BY type = 'ALL', type) AS report FROM s GROUP BY corpus""",
        "sql_functions": f"""
            WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PATTERNS["EMAIL"][0]}')) AS v, 'EMAIL' AS type FROM documents
                UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '{_PATTERNS["CREDIT_CARD"][0]}')), 'CREDIT_CARD' FROM documents
                UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '{_PATTERNS["IP_ADDRESS"][0]}')), 'IP_ADDRESS' FROM documents)
            SELECT doc_id, type, CASE type WHEN 'EMAIL' THEN lower(v) WHEN 'IP_ADDRESS' THEN v ELSE {digits} END AS value FROM v
            WHERE type <> 'CREDIT_CARD' OR (length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN (length({digits}) - j) % 2 = 0 THEN substr({digits}, j::int, 1)::int WHEN substr({digits}, j::int, 1)::int > 4 THEN substr({digits}, j::int, 1)::int * 2 - 9 ELSE substr({digits}, j::int, 1)::int * 2 END)) % 10 = 0)""",
        "redacted_text": f"""{e}, {ordinal},
            c AS (SELECT doc_id, unit, list(struct_pack(s := start, t := "end", f := fake) ORDER BY start) AS cuts FROM i JOIN m USING (doc_id, type, key) GROUP BY doc_id, unit)
            SELECT doc_id, unit, CASE WHEN cuts IS NULL THEN text ELSE
                array_to_string(list_transform(range(1, len(cuts) + 1), lambda k: substr(text, (CASE WHEN k = 1 THEN 0 ELSE cuts[k - 1].t END + 1)::int, (cuts[k].s - CASE WHEN k = 1 THEN 0 ELSE cuts[k - 1].t END)::int) || cuts[k].f), '') || substr(text, (cuts[len(cuts)].t + 1)::int) END AS redacted
            FROM l LEFT JOIN c USING (doc_id, unit)""",
        "address_blocks": f"""{e}, j AS (SELECT l.doc_id, l.unit, length(text) <= 120 AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = l.doc_id AND e.unit = l.unit) AND NOT regexp_matches(text, '^\\s*[A-Za-z][A-Za-z0-9 /&.\\-]{{1,28}}:') AS ok FROM l),
            w AS (SELECT *, sum((NOT ok)::int) OVER (PARTITION BY doc_id ORDER BY unit) AS island FROM j),
            r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY unit) - 1) // 5 AS chunk FROM w WHERE ok)
            SELECT doc_id, min(unit) AS first_unit, count(*) AS n_units FROM r GROUP BY doc_id, island, chunk HAVING count(*) >= 2""",
    }
    # the documents hold none of the listed names, so with them the run must give the same
    return out | {"stream_redact_folder": out["redacted_text"], "redacted_named": out["redacted_text"]}
