"""The SQL functions against the column expressions that they name, over the cases of the queries."""

from pyspark.sql import functions as F

from palimpsest.functions import predicates as P
from palimpsest.functions.sql import FUNCTIONS, register
from palimpsest.plans import cases


def test_functions_agree_with_columns(spark):
    assert register(spark) == list(FUNCTIONS) == register(spark)
    names = [n for n, _ in cases.PEOPLE + cases.COMPANIES + cases.LEADING] + ["", None, "+91 (20) 1234", "4111 1111-1111 1111", " (AMBER  – x). "]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    same = {
        "pii_plausible_company(n)": P.plausible_company(F.col("n")),
        "pii_luhn_valid(n)": P.luhn_valid(F.col("n")),
        "pii_digits(n)": P.digits(F.col("n")),
        "pii_key('PERSON', n)": P.normalise(F.col("n")),
        "pii_eval_key(n)": P.normalise_eval(F.col("n")),
    }
    for sql, column in same.items():
        assert df.where(~F.expr(sql).eqNullSafe(column)).collect() == [], sql


def test_lists_and_roles(spark):
    register(spark)
    text = "Ann Lee, CFO of Amber Foods Limited: a.b@c.org, +1 (743) 555-3824, 10.0.0.7, 4111111111111111, 123-45-6789, ABCDE1234F"
    row = spark.createDataFrame([(text,)], "t string").selectExpr("pii_emails(t)", "pii_phones(t)", "pii_ip_candidates(t)", "pii_card_candidates(t)", "pii_ssn_candidates(t)", "pii_pans(t)", "pii_company_candidates(t)", "pii_role(t)", "pii_contexts_conflict('director', '', 'treasurer', '')").first()
    assert tuple(row) == (["a.b@c.org"], ["+1 (743) 555-3824"], ["10.0.0.7"], ["4111111111111111"], ["123-45-6789"], ["ABCDE1234F"], ["Amber Foods Limited"], "CFO", True)
