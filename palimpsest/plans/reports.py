"""Reports on runs and their quality, one row a document or corpus: Markdown and the JSON of a job's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import report

#: How many wrong findings a report lists, of one run and of several corpora.
LISTED_RUN, LISTED_CORPORA = 40, 30
NOTE = "No ground-truth annotations were supplied for this document, so precision, recall and F1 cannot be computed."


def counts(ents: DataFrame) -> DataFrame:
    """``doc_id, by_type``: (type, n) of each type, the most frequent first."""
    n = ents.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type", "n")))
    return n.groupBy("doc_id").agg(F.transform(ordered, lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("by_type"))


def summaries(run, files: DataFrame) -> DataFrame:
    """``doc_id, path, text_units, total_entities, unique_entities, images_found, images_blanked, by_type`` of every file."""
    one = files.select("doc_id", "path", "images_found", "images_blanked").join(run.summary(), "doc_id", "left").join(counts(run.entities), "doc_id", "left")
    none = F.array().cast("array<struct<type:string,n:bigint>>")
    return one.fillna(0, ["text_units", "total_entities", "unique_entities"]).withColumn("by_type", F.coalesce("by_type", none))


def wrong(outcomes: DataFrame, most: int) -> DataFrame:
    """``corpus, fps, fns``: the first ``most`` of each, in the order of the document and of the annotations."""
    def first(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("outcome") == kind, F.struct("ord", "type", "text"))))
        return F.transform(F.slice(rows, 1, most), lambda x: F.concat(F.lit("- `"), x["text"], F.lit("` ("), x["type"], F.lit(")")))

    ranked = outcomes.where("outcome <> 'tp'")
    return ranked.groupBy("corpus").agg(first("fp").alias("fps"), first("fn").alias("fns"))


def _listed(title: str, items: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n{title}\n\n"), F.array_join(items, "\n"))).otherwise("")


def run_report(of: DataFrame, generated: str, metrics: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """``doc_id, report`` of ``summaries`` with their ``corpus``: counts, occurrences by type and, where annotations exist, the quality."""
    head = F.concat(
        F.lit("# PII Redaction - Evaluation Report\n\n- **Document:** "), F.col("corpus"), F.lit(f"\n- **Generated:** {generated}\n- **Text units scanned:** "), F.col("text_units").cast("string"),
        F.lit("\n- **PII occurrences replaced:** "), F.col("total_entities").cast("string"), F.lit("\n- **Unique entities:** "), F.col("unique_entities").cast("string"),
        F.lit("\n- **Images found / neutralised:** "), F.col("images_found").cast("string"), F.lit(" / "), F.col("images_blanked").cast("string"),
        F.lit("\n\n## Detected entities by category\n\n| PII Type | Occurrences |\n|---|---|"),
        F.array_join(F.transform("by_type", lambda x: F.concat(F.lit("\n| "), x["type"], F.lit(" | "), x["n"].cast("string"), F.lit(" |"))), ""), F.lit("\n\n## Detection quality\n\n"),
    )
    if metrics is None:
        return of.select("doc_id", F.concat(head, F.lit(NOTE)).alias("report"))
    scored = of.join(report(metrics).withColumnRenamed("report", "table"), "corpus", "left").join(wrong(outcomes, LISTED_RUN), "corpus", "left")
    quality = F.concat(F.col("table"), _listed("### False positives", "fps"), _listed("### False negatives", "fns"))
    return scored.select("doc_id", F.concat(head, F.coalesce(quality, F.concat(F.col("table"), F.lit("")), F.lit(NOTE))).alias("report"))


def corpora_report(of: DataFrame, metrics: DataFrame, outcomes: DataFrame, scope: DataFrame) -> DataFrame:
    """``corpus, section`` of ``summaries`` with their ``corpus``: a section of the report on several corpora each."""
    bounded = scope.where(F.col("unit_end") < 2**31 - 1).select("corpus", F.concat(F.lit("\n- Evaluation scope: text units **"), F.col("unit_start").cast("string"), F.lit("-"), F.col("unit_end").cast("string"), F.lit("** (exhaustively annotated)")).alias("said"))
    rows = of.join(report(metrics).withColumnRenamed("report", "table"), "corpus").join(wrong(outcomes, LISTED_CORPORA), "corpus", "left").join(bounded, "corpus", "left")
    text = F.concat(
        F.lit("## "), F.col("corpus"), F.lit("\n\n- Paragraphs / table cells scanned: **"), F.col("text_units").cast("string"), F.lit("**\n- PII occurrences replaced: **"), F.col("total_entities").cast("string"),
        F.lit("**\n- Unique entities mapped: **"), F.col("unique_entities").cast("string"), F.lit("**\n- Images found / neutralised: **"), F.col("images_found").cast("string"), F.lit(" / "), F.col("images_blanked").cast("string"), F.lit("**"),
        F.coalesce("said", F.lit("")), F.lit("\n\n"), F.col("table"), F.coalesce(F.concat(_listed("**False positives**", "fps"), _listed("**False negatives**", "fns")), F.lit("")),
    )
    return rows.select("corpus", text.alias("section"))


def status(of: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """``doc_id, status``: the state of a finished job as JSON; ratios with four decimals, null without annotations."""
    summary = F.struct("text_units", "total_entities", "unique_entities", "images_found", "images_blanked", F.map_from_entries("by_type").alias("counts_by_type"))
    base = (F.lit("done").alias("status"), F.lit("").alias("stage"), F.lit(100).alias("percent"), F.col("corpus").alias("filename"), F.lit(None).cast("string").alias("error"), summary.alias("summary"))
    keep = {"ignoreNullFields": "false"}
    if metrics is None:
        note = F.lit("Scoring needs a ground-truth file.").alias("metrics_note")
        return of.select("doc_id", F.to_json(F.struct(*base, F.lit(None).cast("string").alias("metrics"), note), keep).alias("status"))
    four = [F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")]
    overall = F.max(F.when(F.col("type") == "ALL", F.struct(*four, F.round("accuracy", 4).alias("accuracy"), "tp", "fp", "fn"))).alias("overall")
    by_type = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("type") != "ALL", F.struct("type", F.struct(*four, "support")))))).alias("by_type")
    scores = metrics.groupBy("corpus").agg(overall, by_type).select("corpus", F.struct("overall", "by_type").alias("metrics"))
    return of.join(scores, "corpus", "left").select("doc_id", F.to_json(F.struct(*base, "metrics"), keep).alias("status"))
