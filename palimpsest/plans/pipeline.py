"""The whole run: documents to rewritten units, stand-ins and a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import discard_run, materialize
from ..operators.blocks import stitch
from ..operators.detect import detect, entities
from ..operators.identity import resolve_identities
from ..operators.names import Provider, of_names, with_names
from ..operators.propagate import propagate
from ..operators.surrogates import SEED, rewrite, surrogates
from ..sources.docx import docx_units, read_docx_files, rewrite_docx
from ..sources.units import MAX_BYTES, SUFFIXES, read_text_files, too_large, units


@dataclass
class Redaction:
    detected: DataFrame
    entities: DataFrame
    surrogates: DataFrame
    redacted: DataFrame

    def documents(self) -> DataFrame:
        """``doc_id, text``: the rewritten units of each document, a line each."""
        lines = self.redacted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit", "redacted"))).alias("u"))
        return lines.select("doc_id", F.array_join(F.transform("u", lambda x: x["redacted"]), "\n").alias("text"))

    def summary(self) -> DataFrame:
        n = self.detected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("text_units"), F.sum(F.size("ents")).alias("total_entities"))
        unique = self.surrogates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unique_entities"))
        return n.join(unique, "doc_id", "left").fillna(0, ["unique_entities"])


class Cancelled(Exception):
    """Raised by a progress hook to stop a run before its next step."""


def redact(docs: DataFrame, names: DataFrame | None = None, stitched: bool = True, **how) -> Redaction:
    """``redact_units`` of the non-blank lines of ``docs`` (doc_id, text)."""
    return redact_units(units(docs, coded=stitched), names, stitched, **how)


def redact_units(of: DataFrame, names: DataFrame | None = None, stitched: bool = True, *, provider: Provider | None = None, seed: int = SEED, progress: Callable[[str, float], None] | None = None) -> Redaction:
    """``provider`` finds people and companies (``names``, rows of value and type, makes one); with it known names are propagated too.

    What the rules and the provider find is resolved together. Detection, which several steps read, is written once to the shared
    folder, and once more when propagation changed it. Stitching moves and writes again only the units whose ``code`` is not false
    (``sources.units``; all where ``of`` has no such column). ``progress`` is told each step and the share done
    before it begins, and may raise ``Cancelled``; tables written by then are deleted.
    """
    tell = progress or (lambda step, share: None)
    provider = of_names(names) if provider is None and names is not None else provider
    try:
        tell("Scanning for structured data", 0.04)
        if provider is None:
            found = materialize(detect(of), "detected")
        else:
            raw = materialize(detect(of, resolved=False), "rules")
            tell("Detecting names and organisations", 0.10)
            found = materialize(with_names(raw, provider), "detected")
        if stitched:
            tell("Linking addresses across paragraphs", 0.78)
            if "code" in found.columns:
                coded = F.coalesce("code", F.lit(True))
                found = found.where(~coded).unionByName(materialize(stitch(found.where(coded)), "stitched")).drop("code")
            else:
                found = materialize(stitch(found), "stitched")
        if provider is not None:
            tell("Finding repeated mentions", 0.82)
            found = materialize(propagate(found), "propagated")
        tell("Resolving identities", 0.88)
        ents = resolve_identities(entities(found))
        ids = surrogates(ents, seed=seed)
        tell("Writing", 0.92)
        return Redaction(found, ents, ids, rewrite(found, ents, ids))
    except Cancelled:
        discard_run()
        raise


def redact_files(spark: SparkSession, path: str, out: str, *, docx: bool = False, keep_images: bool = False, max_bytes: int = MAX_BYTES, **how) -> FileRun:
    """Rewrite the text or Word files under ``path`` into ``out`` (Parquet: doc_id, path and text or content)."""
    suffixes = ("docx",) if docx else SUFFIXES
    refused = too_large(spark, path, max_bytes, suffixes)
    if docx:
        files = read_docx_files(spark, path, max_bytes)
        run = redact_units(docx_units(files), **how)
        made = rewrite_docx(files, run.redacted, blank=not keep_images).join(files.select("doc_id", "path"), "doc_id")
        made.write.mode("overwrite").parquet(out)
        images = spark.read.parquet(out).select("doc_id", "path", "images_found", "images_blanked", "error")
    else:
        files = read_text_files(spark, path, max_bytes)
        run = redact(files.select("doc_id", "text"), **how)
        files.select("doc_id", "path").join(run.documents(), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit(""))).write.mode("overwrite").parquet(out)
        none = F.lit(0)
        images = files.select("doc_id", "path", none.alias("images_found"), none.alias("images_blanked"), F.lit(None).cast("string").alias("error"))
    return FileRun(run, images, refused)


@dataclass
class FileRun:
    """``files``: ``doc_id, path, images_found, images_blanked, error``; ``refused``: ``path, length`` of files beyond the cap."""

    run: Redaction
    files: DataFrame
    refused: DataFrame
