"""Plans that hold at any size: nothing that grows with the input is broadcast, and steps that are read twice are written once."""

import re

from pyspark.sql import functions as F

from palimpsest.operators import propagate
from palimpsest.plans import cases, derived


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_outcomes_broadcast_nothing(spark, sf):
    assert "BroadcastExchange" not in plan(cases.eval_address(spark, sf))


def test_words_are_not_broadcast(spark, sf):
    """The few names are sent to the words, or the two are sorted where the names are many; both find the same."""
    of = cases.lines(cases.customers(spark, sf).where("k < 40"), F.lit("met Asha Kelby"))
    few = propagate.listed(of, cases.all_names(spark))
    assert not re.search(r"BroadcastExchange[^\n]*\n[^\n]*Generate", plan(few)) and few.count() == 40
    many = propagate.listed(of, cases.all_names(spark), most_sent=10)
    assert "BroadcastExchange" not in plan(many) and many.count() == 40


def test_provided_identities_read_written_steps(spark, sf):
    assert len(plan(cases.provided_identities(spark, sf))) < 300_000


def test_synthetic_records_are_detected_once(spark, sf):
    """No rule is left in the plan of the scoring, however often it reads the entities."""
    made = plan(derived.synthetic_quality(spark, sf))
    assert "posexplode" not in made and len(made) < 300_000
