"""Text units: the non-blank lines of documents, numbered in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.spans import CLOSE, INNER, OPEN, once

LINE_BREAKS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\u2028\u2029]"


#: What every postcode contains; a search for it is much cheaper.
CODE_GATE = r"[0-9](?:[0-9]{2}\s?[0-9]{2}|[A-Z])"


def units(docs: DataFrame, text: str = "text", id_: str = "doc_id", coded: bool = False) -> DataFrame:
    """``doc_id, unit, location, text``: one row a non-blank line; no shuffle. Marks used inside the engine become U+FFFD.

    ``coded`` adds ``code``: whether anything like a postcode stands in the document, without which no address is split over its lines.
    Conditions on documents belong before this: lines are cut once, behind which Catalyst moves no filter (``spans.once``).
    """
    clean = F.translate(F.col(text), OPEN + CLOSE + INNER, "\ufffd" * 3)
    lines = once(F.filter(F.split(clean, LINE_BREAKS, -1), lambda x: x.rlike("[!-~]") | x.rlike(r"(?U)\S")))
    more = {"code": F.col(text).rlike(CODE_GATE) & F.col(text).rlike(L.POSTCODE)} if coded else {}
    # the lines are a projection of their own, so that what is said of a document isn't worked out again for each of them
    made = docs.select(F.col(id_).alias("doc_id"), *(c.alias(n) for n, c in more.items()), lines.alias("_lines"))
    return made.select("doc_id", *more, F.posexplode("_lines").alias("unit", "text")).select("doc_id", "unit", F.lit("body").alias("location"), "text", *more)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where the input comes in fewer partitions (small or unsplittable files); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


SUFFIXES = ("txt", "md", "text", "log", "csv")
#: Largest file that is taken, in bytes.
MAX_BYTES = 8 << 20


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """The files under ``path`` (a folder, file or glob) with one of the suffixes, in any case."""
    ends = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in x) for x in suffixes)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{ends}}}").load(path)


def too_large(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``path, length`` of the files that the size cap refuses; no content is read."""
    return listing(spark, path, suffixes).where(F.col("length") > max_bytes).select("path", "length")


def read_text_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Whole text files of the accepted suffixes within the size cap, as ``doc_id, path, text``; content of larger files isn't read.

    Bytes that are not UTF-8 become U+FFFD. Files without any byte give no row. ``too_large`` lists what the cap leaves out.
    """
    files = listing(spark, path, suffixes).where(F.col("length") <= max_bytes)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
