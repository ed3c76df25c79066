"""Queries over texts derived from the relational tables, for the rules that the documents don't exercise, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import materialize
from ..operators import detect, evaluate
from ..operators.detect import detected_entities
from ..sources import synthetic
from ..sources.units import spread, units


def spans(df: DataFrame, key: str, text: str, found: Callable[[Column], Column]) -> DataFrame:
    """``key, text, start`` of the entities found in a text expression."""
    said = df.select(F.col(key).alias("key"), F.expr(text).alias("said"))
    return said.select("key", F.explode(found(F.col("said"))).alias("e")).select("key", F.col("e.text").alias("text"), F.col("e.start").cast("long").alias("start"))


def rule(type_: str) -> Callable[[Column], Column]:
    return lambda text: detect.pattern_entities(text, type_)


#: Query -> table, key, value by the key k (the same in both dialects), words before it, detector, and which rows hold an entity.
_SSN = "concat(lpad(cast(k * 7 % 1000 as string), 3, '0'), '-', lpad(cast(k % 100 as string), 2, '0'), '-', lpad(cast(k % 10000 as string), 4, '0'))"
_IP = "concat(cast(k % 256 as string), '.', cast(k % 300 as string), '.', cast(k * 3 % 256 as string), '.', cast(1 + k % 200 as string))"
_PAN = "concat(CASE WHEN k % 2 = 0 THEN 'QWXYZ' ELSE 'qwxyz' END, lpad(cast(k % 10000 as string), 4, '0'), 'K')"
_DIN = "lpad(cast(k % 100000000 as string), 8, '0')"
_COMPANY = "concat(CASE k % 3 WHEN 0 THEN 'Amber' WHEN 1 THEN 'Brook' ELSE 'Calder' END, ' Valley Foods ', CASE k % 2 WHEN 0 THEN 'Limited' ELSE 'limited' END)"
_ADDRESS = "concat(cast(k as string), ' Mill Lane, Pune - 4', lpad(cast(k % 100 as string), 2, '0'), ' 0', lpad(cast(k % 100 as string), 2, '0'))"
DERIVED = {
    "derived_ssn": ("customer", "c_custkey", _SSN, "CASE WHEN k % 2 = 0 THEN 'SSN: ' ELSE 'Invoice no: ' END", rule("SSN"), "k % 2 = 0 AND k * 7 % 1000 NOT IN (0, 666) AND k * 7 % 1000 < 900 AND k % 100 <> 0 AND k % 10000 <> 0"),
    "derived_ip": ("orders", "o_orderkey", _IP, "CASE WHEN k % 3 = 0 THEN 'Version ' ELSE 'Host ' END", rule("IP_ADDRESS"), "k % 3 <> 0 AND k % 300 < 256"),
    "derived_pan": ("supplier", "s_suppkey", _PAN, "'PAN '", rule("PAN"), "k % 2 = 0"),
    "derived_din": ("supplier", "s_suppkey", _DIN, "CASE WHEN k % 2 = 0 THEN 'DIN: ' ELSE 'No. ' END", rule("DIN"), "k % 2 = 0"),
    "derived_company": ("supplier", "s_suppkey", _COMPANY, "'supplied by '", detect.company_entities, "k % 2 = 0"),
    "derived_address": ("customer", "c_custkey", _ADDRESS, "''", detect.address_entities, "true"),
}


def derived(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, key, value, words, found, _ = DERIVED[name]

    def query(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("k"))
        return spans(rows, "k", f"concat({words}, {value})", found)

    return query


def derived_dob(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), "o_orderdate")
    date = "CASE k % 3 WHEN 0 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'd MMMM yyyy') END"
    return spans(orders, "k", f"concat(CASE WHEN k % 2 = 0 THEN 'Born on ' ELSE 'Due on ' END, {date})", detect.dob_entities)


def evaluation_metrics(spark, sf_dir):
    """Annotated addresses of customers against predictions that lack some, vary in case and add others."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    mail = F.concat(F.lit("user"), F.col("k").cast("string"), F.lit("@example.com"))
    row = lambda text, ord_=F.col("k"): (F.lit("customers").alias("corpus"), ord_.alias("ord"), text.alias("text"), F.lit("EMAIL").alias("type"))
    truth = c.select(*row(mail))
    hits = c.where("k % 5 <> 0").select(*row(F.when(F.col("k") % 3 == 0, F.upper(mail)).otherwise(mail)))
    extra = c.where("k % 7 = 0").select(*row(F.concat(F.lit("extra"), mail), -F.col("k")))
    return evaluate.metrics(evaluate.outcomes(hits.unionByName(extra), truth))


def synthetic_quality(spark, sf_dir):
    """Synthetic records of all customers, detected by the rules and scored against their truth; by type over all records.

    The keys are a small file that makes much text, so they are dealt over the cores; what the scoring reads several times is written once.
    """
    of = synthetic.records(spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))))
    found = detected_entities(units(synthetic.documents(of))).select(F.col("doc_id").cast("string").alias("corpus"), "unit", "start", "type", "text")
    out, _ = evaluate.evaluate(materialize(found, "found"), materialize(synthetic.annotations(of), "annotations"))
    return evaluate.metrics(out.withColumn("corpus", F.lit("synthetic"))).select("type", "tp", "fp", "fn", "precision", "recall", "f1", "accuracy", "support")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: derived(name) for name in DERIVED} | {"derived_dob": derived_dob, "evaluation_metrics": evaluation_metrics, "synthetic_quality": synthetic_quality}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (table, key, value, words, _, holds) in DERIVED.items():
        out[name] = f"SELECT k AS key, {value} AS text, length({words})::bigint AS start FROM (SELECT {key}::bigint AS k FROM {table}) WHERE {holds}"
    out["derived_dob"] = """
        SELECT k AS key, CASE k % 3 WHEN 0 THEN strftime(d, '%B %-d, %Y') WHEN 1 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%-d %B %Y') END AS text, 8::bigint AS start
        FROM (SELECT o_orderkey::bigint AS k, o_orderdate AS d FROM orders) WHERE k % 2 = 0"""
    out["evaluation_metrics"] = """
        WITH n AS (SELECT count(*) FILTER (c_custkey % 5 <> 0) AS tp, count(*) FILTER (c_custkey % 7 = 0) AS fp, count(*) FILTER (c_custkey % 5 = 0) AS fn FROM customer),
        r AS (SELECT *, tp::double / (tp + fp)::double AS precision, tp::double / (tp + fn)::double AS recall FROM n)
        SELECT 'customers' AS corpus, type, tp, fp, fn, precision, recall, 2 * precision * recall / (precision + recall) AS f1, tp::double / (tp + fp + fn)::double AS accuracy, tp + fn AS support
        FROM r, (VALUES ('EMAIL'), ('ALL')) t(type)"""
    # every annotated value is found and nothing else; eleven annotations and a number more of the types with two a record
    out["synthetic_quality"] = """
        WITH t AS (SELECT type, n * (SELECT count(*) FROM customer) AS tp FROM (VALUES ('PERSON', 2), ('EMAIL', 2), ('PHONE', 1), ('DOB', 1), ('SSN', 1), ('CREDIT_CARD', 1), ('IP_ADDRESS', 1), ('COMPANY', 2), ('ADDRESS', 1), ('ALL', 12)) v(type, n))
        SELECT type, tp, 0::bigint AS fp, 0::bigint AS fn, 1.0::double AS precision, 1.0::double AS recall, 1.0::double AS f1, 1.0::double AS accuracy, tp AS support FROM t"""
    return out
