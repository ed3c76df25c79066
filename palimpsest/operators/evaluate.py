"""Scoring of predictions against annotations: deduplicated, matched by type, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.predicates import digits, normalise_eval
from ..functions.stage import sorted_join


def dedupe(items: DataFrame) -> DataFrame:
    """``corpus, ord, text, type, key``: the first of each key and type."""
    keyed = items.withColumn("key", F.when(F.col("type") == "PHONE", digits(F.col("text"))).otherwise(normalise_eval(F.col("text"))))
    first = Window.partitionBy("corpus", "type", "key").orderBy("ord")
    return keyed.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def in_scope(predictions: DataFrame, scope: DataFrame) -> DataFrame:
    """Predictions whose unit lies in the annotated range of their corpus, both ends included."""
    return predictions.join(scope, "corpus").where(F.col("unit").between(F.col("unit_start"), F.col("unit_end"))).drop("unit_start", "unit_end")


#: Characters of a key by which the contained text and the containing one meet.
GRAM = 8


def contained(p: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs of rows of which one key contains the other.

    The first GRAM characters of the contained key stand somewhere in the containing one: an equi-join on them, either way round, before
    the containment is tried. Keys that are shorter meet on their own length.
    """
    sizes = t.select(F.length("t_key").alias("n")).unionByName(p.select(F.length("p_key").alias("n"))).where(F.col("n") < GRAM).distinct()
    least = sorted({GRAM, *(r.n for r in sizes.collect() if r.n)})  # at most GRAM lengths

    def first(key: str) -> Column:
        return F.substring(key, 1, GRAM)

    def pieces(key: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - (n - 1), F.lit(1))), lambda i: F.substring(F.col(key), i, F.lit(n)))

    def grams(key: str) -> Column:
        return F.explode(F.array_distinct(F.flatten(F.array(*(pieces(key, n) for n in least)))))

    on = ["corpus", "type", "g"]
    inside = sorted_join(p.withColumn("g", first("p_key")), t.withColumn("g", grams("t_key")), on).where(F.contains("t_key", "p_key"))
    around = sorted_join(p.withColumn("g", grams("p_key")), t.withColumn("g", first("t_key")), on).where(F.contains("p_key", "t_key"))
    # an empty key stands in every other one
    none = sorted_join(p.where("p_key = ''"), t, ["corpus", "type"]).unionByName(sorted_join(p, t.where("t_key = ''"), ["corpus", "type"]))
    return inside.drop("g").unionByName(around.drop("g")).unionByName(none).distinct()


def outcomes(predictions: DataFrame, annotations: DataFrame) -> DataFrame:
    """``corpus, type, ord, text, outcome`` (tp: an annotation found; fn: one not found; fp: a prediction without annotation).

    Addresses match by containment either way and several fragments may meet one annotation, the earliest; others match on
    their key, phones only with eight digits or more.
    """
    pred, truth = dedupe(predictions), dedupe(annotations)
    t = truth.select("corpus", "type", F.col("ord").alias("t_ord"), F.col("text").alias("t_text"), F.col("key").alias("t_key"))
    p = pred.select("corpus", "type", F.col("ord").alias("p_ord"), F.col("text").alias("p_text"), F.col("key").alias("p_key"))
    usable = (F.col("type") != "PHONE") | (F.length("t_key") >= L.PHONE_DIGITS)
    exact = sorted_join(p.where("type <> 'ADDRESS'"), t.where(usable).withColumnRenamed("t_key", "p_key"), ["corpus", "type", "p_key"]).select("corpus", "type", "p_ord", "t_ord")
    parts = contained(p.where("type = 'ADDRESS'"), t.where("type = 'ADDRESS'"))
    met = exact.unionByName(parts.groupBy("corpus", "type", "p_ord").agg(F.min("t_ord").alias("t_ord")))
    found = met.select("corpus", "type", "t_ord").distinct().withColumn("_hit", F.lit(True))
    of_truth = sorted_join(t, found, ["corpus", "type", "t_ord"], "left").select("corpus", "type", F.col("t_ord").alias("ord"), F.col("t_text").alias("text"), F.when(F.col("_hit"), "tp").otherwise("fn").alias("outcome"))
    extra = sorted_join(p, met, ["corpus", "type", "p_ord"], "left_anti").select("corpus", "type", F.col("p_ord").alias("ord"), F.col("p_text").alias("text"), F.lit("fp").alias("outcome"))
    return of_truth.unionByName(extra)


def metrics(out: DataFrame) -> DataFrame:
    """Counts and ratios by corpus and type, and over all types (type ``ALL``); 0 where a denominator is 0."""
    n = out.rollup("corpus", "type").agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("tp", "fp", "fn")), F.grouping_id().alias("g")).where("g <= 1")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return n.select("corpus", F.when(F.col("g") == 1, "ALL").otherwise(F.col("type")).alias("type"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(tp, tp + fp + fn).alias("accuracy"), (tp + fn).alias("support"))


def report(scores: DataFrame) -> DataFrame:
    """``corpus, report``: a Markdown table of the scores under the corpus' name, types in order, all types last."""
    bold = F.col("type") == "ALL"
    ratio = lambda c: F.when(bold, F.format_string("**%.2f**", c)).otherwise(F.format_string("%.2f", c))
    cells = [F.when(bold, F.lit("**OVERALL**")).otherwise(F.col("type")), *(ratio(c) for c in ("precision", "recall", "f1", "accuracy")), *(F.col(c).cast("string") for c in ("tp", "fp", "fn", "support"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = scores.groupBy("corpus").agg(F.array_sort(F.collect_list(F.struct(bold.alias("last"), "type", line.alias("line")))).alias("rows"))
    head = "| PII Type | Precision | Recall | F1 | Accuracy | TP | FP | FN | Support |\n|---|---|---|---|---|---|---|---|---|\n"
    return rows.select("corpus", F.concat(F.lit("### Corpus: "), F.col("corpus"), F.lit("\n\n" + head), F.array_join(F.transform("rows", lambda x: x["line"]), "\n")).alias("report"))


def evaluate(ents: DataFrame, annotations: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, metrics) of detected entities (corpus, unit, start, type, text) against annotations, within the annotated scope if given."""
    seen = ents if scope is None else in_scope(ents, scope)
    place = F.shiftleft(F.col("unit").cast("long"), 31) + F.col("start")
    out = outcomes(seen.select("corpus", place.alias("ord"), "text", "type"), annotations.select("corpus", F.col("ord").cast("long").alias("ord"), "text", "type"))
    return out, metrics(out)
