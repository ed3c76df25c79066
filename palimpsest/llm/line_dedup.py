"""Site-relative line deduplication, with DataFrame functions only.

For each host the pages that hold a line are counted and divided by the host's pages; lines beyond ``max_ratio`` (on at
least ``min_pages`` pages) are boilerplate there and leave the texts. A line counts once a page, trimmed of spaces, and blank lines are
neither counted nor dropped. Hashes of lines are counted first; only lines whose hash passes are counted again by their text,
so that two lines of one hash are told apart and few texts are shuffled. Both counts are partial aggregates before the shuffle, so a
host or line of any size costs one row a task. The boilerplate table has at most (lines a page / max_ratio) rows a host; its bytes are
summed and it is broadcast within the bound, else joined by host with a salt over the pages.

Defined cases: null texts stay null; empty texts stay empty; a null host is a host of its own, apart from an empty one; repeated rows are pages of their own;
an empty table stays empty; other columns are kept, whatever their names (``n_chars`` is set to the new length where present).
A page whose every line is boilerplate keeps its row with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import BROADCAST_BYTES, fits_broadcast, materialize

MAX_RATIO = 0.1
MIN_PAGES = 10
#: Parts over which the pages of a host are dealt where the boilerplate table is too large to broadcast.
SALTS = 64


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def boilerplate(docs: DataFrame, host: str, text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host, _line, pages, host_pages`` of the lines that are boilerplate of their host."""
    pages = docs.select(F.col(host).alias("_host"), F.col(text).alias("_text"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = F.array_distinct(F.transform(F.filter(lines_of(F.col("_text")), lambda x: F.trim(x) != ""), F.trim))

    def often(counts: DataFrame) -> DataFrame:
        all_ = totals.select(F.col("_host").alias("_of"), "host_pages")
        rows = counts.where(F.col("pages") >= min_pages).join(all_, F.col("_host").eqNullSafe(F.col("_of"))).drop("_of")
        return rows.where(F.col("pages") > F.col("host_pages") * F.lit(max_ratio))

    count = F.count(F.lit(1)).alias("pages")
    keys = pages.select("_host", F.explode(F.transform(lines, line_key)).alias("_key")).groupBy("_host", "_key").agg(count)
    likely = materialize(often(keys).select(F.col("_host").alias("_of"), "_key"), "line-keys")
    same = F.col("_host").eqNullSafe(F.col("_of")) & (F.col("_bad").isNotNull())
    by_host = likely.groupBy("_of").agg(F.collect_set("_key").alias("_bad"))
    if not fits_broadcast(likely, 16):
        by_host = by_host.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages, same = pages.withColumn("_part_of", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")), same & (F.col("_part") == F.col("_part_of"))
    else:
        by_host = F.broadcast(by_host)
    flagged = F.filter(lines, lambda x: F.array_contains(F.col("_bad"), line_key(x)))
    return often(pages.join(by_host, same).select("_host", F.explode(flagged).alias("_line")).groupBy("_host", "_line").agg(count))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    bad = materialize(boilerplate(docs, host, text, max_ratio, min_pages), "lines")
    hosts = bad.groupBy(F.col("_host").alias("_of")).agg(F.sort_array(F.collect_list("_line")).alias("_bad"))
    # the row as one struct: its columns can't clash with the ones made here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(host).alias("_host"), F.col(text).alias("_text"))
    same = F.col("_host").eqNullSafe(F.col("_of"))
    if (bad.agg(F.sum(F.octet_length("_line") + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(hosts), same, "left")
    else:
        salted = hosts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_salt") == F.col("_part")), "left")
    lines = lines_of(F.col("_text"))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_bad"), F.trim(x)))
    joined = joined.withColumn("_kept", F.when(F.col("_bad").isNull(), lines).otherwise(kept))
    out = {c: F.col("_row").getField(c) for c in docs.columns}
    out[text] = F.array_join("_kept", "\n")
    if "n_chars" in out:
        out["n_chars"] = F.length(out[text]).cast(docs.schema["n_chars"].dataType)
    if counts:
        n = F.coalesce(F.when(F.col("_text").isNotNull(), F.size(lines)), F.lit(0))
        out["n_lines"] = n.cast("long")
        out["n_dropped"] = (n - F.when(F.col("_text").isNotNull(), F.size("_kept")).otherwise(0)).cast("long")
    return joined.select(*(c.alias(n) for n, c in out.items()))
