"""The scalar rules as named SQL functions of a session, for ``spark.sql``; all are SQL expressions that Catalyst inlines.

Those that end in ``_candidates`` give what a pattern matches; guards, trimming and plausibility are the detectors' (``operators.detect``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import lexicons as L


def literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all(pattern: str) -> str:
    return f"regexp_extract_all(txt, {literal(pattern)}, 0)"


_WORDS = "filter(split(txt, '\\\\s+'), t -> t <> '')"

#: Function -> parameters, result type, expression.
FUNCTIONS = {
    "pii_digits": ("txt STRING", "STRING", "regexp_replace(txt, '[^0-9]', '')"),
    "pii_luhn_valid": ("txt STRING", "BOOLEAN", "length(regexp_replace(txt, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(txt, '[^0-9]', ''))"),
    "pii_key": ("kind STRING, txt STRING", "STRING", "CASE WHEN kind = 'PHONE' THEN regexp_replace(txt, '[^0-9]', '') ELSE lower(trim(regexp_replace(txt, '\\\\s+', ' '))) END"),
    "pii_eval_key": ("txt STRING", "STRING", "lower(btrim(trim(regexp_replace(translate(txt, '–—−', '---'), '\\\\s+', ' ')), '.,;:()[]\"\\''))"),
    "pii_emails": ("txt STRING", "ARRAY<STRING>", _all(L.EMAIL)),
    "pii_phones": ("txt STRING", "ARRAY<STRING>", _all("(?U)" + L.PHONE)),
    "pii_ssn_candidates": ("txt STRING", "ARRAY<STRING>", _all(L.SSN)),
    "pii_card_candidates": ("txt STRING", "ARRAY<STRING>", f"filter({_all(L.CREDIT_CARD)}, c -> length(regexp_replace(c, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(c, '[^0-9]', '')))"),
    "pii_ip_candidates": ("txt STRING", "ARRAY<STRING>", _all(L.IP_ADDRESS)),
    "pii_pans": ("txt STRING", "ARRAY<STRING>", _all(L.PAN)),
    "pii_company_candidates": ("txt STRING", "ARRAY<STRING>", _all(L.COMPANY)),
    "pii_role": ("txt STRING", "STRING", f"nullif(regexp_extract(txt, {literal(L.ROLE)}, 1), '')"),
    "pii_plausible_company": (
        "txt STRING",
        "BOOLEAN",
        f"size({_WORDS}) >= 2 AND NOT txt RLIKE {literal(L.any_word(L.STRUCTURE_WORDS))} AND NOT txt RLIKE {literal(L.any_word(L.DOMAIN_TERMS))} AND txt RLIKE {literal(L.any_word(L.COMPANY_SUFFIXES))}"
        f" AND exists({_WORDS}, t -> length(regexp_replace(t, '[^\\\\p{{L}}]', '')) >= 3 AND NOT btrim(t, '.,&') RLIKE {literal('^' + L.any_word(L.COMPANY_SUFFIXES) + '$')})",
    ),
    "pii_contexts_conflict": (
        "role_a STRING, org_a STRING, role_b STRING, org_b STRING",
        "BOOLEAN",
        "role_a <> '' AND role_b <> '' AND (NOT (contains(role_a, role_b) OR contains(role_b, role_a)) OR (org_a <> '' AND org_b <> '' AND org_a <> org_b))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, in place of those of the same names; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
