"""``python -m palimpsest INPUT OUTPUT``: rewrite text or Word files, print what was found and, with annotations, score it."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.stage import discarded
from .operators.evaluate import evaluate, report
from .operators.surrogates import SEED, mapping
from .plans import reports
from .plans.pipeline import redact_files
from .sources.annotations import read_annotations
from .sources.units import MAX_BYTES


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    out.add_argument("input", help="folder, file or glob of .txt, .md, .text, .log, .csv or .docx files")
    out.add_argument("output", help="folder of the rewritten files (Parquet: doc_id, path and text or content)")
    out.add_argument("--docx", action="store_true", help="read Word files")
    out.add_argument("--keep-images", action="store_true", help="leave pictures of Word files as they are")
    out.add_argument("--mapping", help="folder of the spellings and their stand-ins as JSON (holds personal data)")
    out.add_argument("--ground-truth", help="folder or file of annotations; a file without its suffix names the input file it annotates")
    out.add_argument("--names", help="CSV of value,type with a header: names of people and companies to look for")
    out.add_argument("--no-ner", action="store_true", help="rules only, even where names are given")
    out.add_argument("--seed", type=int, default=SEED, help="begins the stand-ins further on")
    out.add_argument("--max-bytes", type=int, default=MAX_BYTES, help="larger files are refused and listed")
    out.add_argument("--report", help="folder of a Markdown report a file")
    out.add_argument("--status", help="folder of the JSON state a file")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    names = None if args.no_ner or not args.names else spark.read.csv(args.names, header=True, schema="value string, type string")
    with discarded():
        try:
            done = redact_files(spark, args.input, args.output, docx=args.docx, keep_images=args.keep_images, max_bytes=args.max_bytes, names=names, seed=args.seed)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            print(f"error: no such file: {args.input}", file=sys.stderr)
            return 1
        refused = done.refused.orderBy("path").toLocalIterator()
        for r in refused:
            print(f"refused, {r.length} bytes are more than {args.max_bytes}: {r.path}", file=sys.stderr)
        for r in done.files.where("error is not null").orderBy("path").toLocalIterator():
            print(f"unreadable, {r.error}: {r.path}", file=sys.stderr)
        corpus = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
        of = reports.summaries(done.run, done.files).withColumn("corpus", corpus)
        total = of.agg(*(F.sum(c).alias(c) for c in ("text_units", "total_entities", "unique_entities", "images_found", "images_blanked"))).first()
        print(f"Redacted: {args.output}")
        for label, value in (("text units scanned", total.text_units), ("PII occurrences replaced", total.total_entities), ("unique entities", total.unique_entities), ("images blanked", f"{total.images_blanked or 0}/{total.images_found or 0}")):
            print(f"  {label:<24}: {value or 0}")
        print("\n  By category:")
        for r in done.run.entities.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").collect():  # one row a type
            print(f"    {r.type:<12} {r.n}")
        if args.mapping:
            mapping(done.run.surrogates).select("doc_id", F.to_json("mapping").alias("mapping")).write.mode("overwrite").json(args.mapping)
        metrics = outcomes = None
        if args.ground_truth:
            annotations, scope = read_annotations(spark, args.ground_truth)
            seen = done.run.entities.join(of.select("doc_id", "corpus"), "doc_id").join(scope.select("corpus"), "corpus", "left_semi")
            outcomes, metrics = evaluate(seen, annotations, scope)
            for r in report(metrics).orderBy("corpus").toLocalIterator():
                print("\n" + r.report)
        if args.report:
            now = spark.sql("SELECT date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
            reports.run_report(of, now, metrics, outcomes).write.mode("overwrite").json(args.report)
        if args.status:
            reports.status(of, metrics).write.mode("overwrite").json(args.status)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
