"""Predicates and trimmers on names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def tokens(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda t: t != "")


def luhn_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def plausible_person(name: Column) -> Column:
    """Two to six tokens with capital initials and no word of places, companies, documents, finance or groups."""
    t = tokens(name)
    noise = [L.PLACE_WORDS, L.COMPANY_SUFFIXES, L.STRUCTURE_WORDS, L.DOMAIN_TERMS, L.PERSON_NOISE]
    ok = F.size(t).between(2, 6) & F.forall(t, lambda x: ~x.rlike(r"^(?!\p{Lu})\p{L}") & ~x.rlike(r"^\p{Nd}"))
    for words in noise:
        ok &= ~name.rlike(L.any_word(words))
    return ok


def plausible_company(name: Column) -> Column:
    """Two tokens or more with a legal suffix, a word of its own, and no document or finance term."""
    t = tokens(name)
    suffix = F.lit("^" + L.any_word(L.COMPANY_SUFFIXES) + "$")
    bare = lambda x: F.btrim(x, F.lit(".,&"))
    is_suffix = lambda x: F.rlike(bare(x), suffix)
    own = F.exists(t, lambda x: (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 3) & ~is_suffix(x))
    return (F.size(t) >= 2) & ~name.rlike(L.any_word(L.STRUCTURE_WORDS)) & ~F.forall(t, is_suffix) & ~name.rlike(L.any_word(L.DOMAIN_TERMS)) & own & name.rlike(L.any_word(L.COMPANY_SUFFIXES))


def clean_company(name: Column) -> Column:
    """Without leading noise words and lower-case words; joined by single spaces."""
    t = tokens(name)
    noise = F.array(*map(F.lit, L.LEADING_NOISE))
    keep = F.transform(t, lambda x: ~(F.array_contains(noise, F.lower(F.btrim(x, F.lit(",")))) | x.rlike(r"^\p{Ll}")))
    first = F.array_position(keep, F.lit(True)).cast("int")
    return F.when(first > 0, F.array_join(F.slice(t, first, F.size(t)), " ")).otherwise("")


def normalise_role(role: Column) -> Column:
    full = F.create_map(*(F.lit(x) for kv in L.INITIALISMS.items() for x in kv))
    return F.array_join(F.transform(tokens(F.lower(role)), lambda w: F.coalesce(F.element_at(full, w), w)), " ")


def person_context(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Role and company said next to a name; empty strings where nothing is said."""
    left = F.substring(text, F.greatest(start - L.ROLE_BEFORE, F.lit(0)) + 1, F.least(start, F.lit(L.ROLE_BEFORE)))
    right = F.substring(text, end + 1, F.lit(L.ROLE_AFTER))
    found = F.coalesce(F.nullif(F.regexp_extract(right, L.ROLE, 1), F.lit("")), F.regexp_extract(left, L.ROLE, 1))
    firm = clean_company(F.btrim(F.trim(F.regexp_extract(right, L.COMPANY, 0)), F.lit(",;")))
    return normalise_role(found), F.when(plausible_company(firm), F.lower(firm)).otherwise("")


def normalise(text: Column) -> Column:
    """Key of an entity's text: single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def normalise_eval(text: Column) -> Column:
    """Key of evaluation: dashes alike, single spaces, outer punctuation stripped, lower case."""
    return F.lower(F.btrim(F.trim(F.regexp_replace(F.translate(text, "–—−", "---"), r"\s+", " ")), F.lit(".,;:()[]\"'")))


def contexts_conflict(role_a: Column, org_a: Column, role_b: Column, org_b: Column) -> Column:
    """Two contexts name different people: roles neither of which contains the other, or like roles at different companies."""
    both = (role_a != "") & (role_b != "")
    alike = F.contains(role_a, role_b) | F.contains(role_b, role_a)
    return both & (~alike | ((org_a != "") & (org_b != "") & (org_a != org_b)))
