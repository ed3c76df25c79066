"""Synthetic documents with annotated truth: one personnel record a key, with people, numbers and lines that must stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _luhn_card(n: Column) -> Column:
    """A card number of a test range whose last digit is the check digit."""
    body = F.concat(F.lit("400000"), F.lpad((n % 10**9).cast("string"), 9, "0"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substring(body, i, F.lit(1)).cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def records(keys: DataFrame) -> DataFrame:
    """``doc_id, lines`` of ``keys`` (k): (text, [(value, type)]) a line; an empty list marks a line without personal data."""
    k = F.col("k")
    name = F.concat_ws(" ", _pick(L.FIRST_NAMES, k), _pick(L.LAST_NAMES, F.floor(k / len(L.FIRST_NAMES))))
    boss = F.concat_ws(" ", _pick(L.FIRST_NAMES, k + 7), _pick(L.LAST_NAMES, F.floor(k / len(L.FIRST_NAMES)) + 5))
    mail, boss_mail = (F.concat(F.lower(F.replace(who, F.lit(" "), F.lit("."))), k.cast("string"), F.lit("@records.example")) for who in (name, boss))
    phone = F.concat(F.lit("+91 98"), F.lpad((k % 10**8).cast("string"), 8, "0"))
    ssn = F.concat_ws("-", (100 + k % 500).cast("string"), (10 + k % 89).cast("string"), (1000 + k % 8999).cast("string"))
    ip = F.concat(F.lit("192.168."), (k % 250).cast("string"), F.lit("."), (1 + k % 200).cast("string"))
    firm, other = (F.concat_ws(" ", _pick(L.LAST_NAMES, k + j), F.lit("Manufacturing Limited" if j else "Industries Limited")) for j in (3, 0))
    born = F.concat((1 + k % 28).cast("string"), F.lit(" March 1992"))
    home = F.concat((1 + k % 99).cast("string"), F.lit(" Mill Street, Kothrud, Pune - 411 0"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(", Maharashtra, India"))
    card = _luhn_card(k)

    def line(*parts) -> Column:
        """Strings stand as they are; (value, type) is annotated."""
        text = F.concat(*(F.lit(p) if isinstance(p, str) else p[0] for p in parts))
        truth = [F.struct(p[0].alias("text"), F.lit(p[1]).alias("type")) for p in parts if not isinstance(p, str)]
        return F.struct(text.alias("text"), (F.array(*truth) if truth else F.array().cast("array<struct<text:string,type:string>>")).alias("truth"))

    n = k.cast("string")
    lines = [
        line("Employee Onboarding Record - Internal"),
        line("Contact Person: ", (name, "PERSON")),
        line("Email: ", (mail, "EMAIL")),
        line("Call ", (phone, "PHONE")),
        line("Date of Birth: ", (born, "DOB")),
        line("SSN: ", (ssn, "SSN")),
        line("Card on file: ", (card, "CREDIT_CARD")),
        line("Last login from IP ", (ip, "IP_ADDRESS")),
        line("Employer: ", (firm, "COMPANY")),
        line("Residence: ", (home, "ADDRESS")),
        line("Contact Person: ", (boss, "PERSON"), " Email: ", (boss_mail, "EMAIL")),
        line("Manufactured by ", (other, "COMPANY")),
        # lines that must stay
        F.struct(F.concat(F.lit("Invoice number "), ssn, F.lit(" was raised for this onboarding.")).alias("text"), F.array().cast("array<struct<text:string,type:string>>").alias("truth")),
        line("The policy was approved by the board on December 10, 2025."),
        F.struct(F.concat(F.lit("Total shares allotted: "), n, F.lit(" at face value 5 each.")).alias("text"), F.array().cast("array<struct<text:string,type:string>>").alias("truth")),
        line("Software build version 10.2.14.3 was deployed to production."),
        line("The company was incorporated on July 30, 1979 under the Companies Act, 1956."),
        line("Reference ticket ID 998877665544332211 remains open."),
    ]
    return keys.select(k.alias("doc_id"), F.array(*lines).alias("lines"))


def documents(of: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``records``."""
    return of.select("doc_id", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def annotations(of: DataFrame) -> DataFrame:
    """``corpus, ord, text, type`` of ``records``; a document is a corpus."""
    truth = of.select("doc_id", F.posexplode(F.flatten(F.transform("lines", lambda x: x["truth"]))).alias("ord", "t"))
    return truth.select(F.col("doc_id").cast("string").alias("corpus"), F.col("ord").cast("long").alias("ord"), "t.text", "t.type")
