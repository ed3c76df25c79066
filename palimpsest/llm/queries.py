"""The registered queries of the training-data operators, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, language_id, line_dedup, near_dup, prefix_bpe, quality_classifier, quality_rules, toxicity, warc
from .pu_learning import fold
from .spark_util import materialize, scratch_path

#: The rank file of op10; its path is a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Text of both turns of the added conversation of op1.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_bytes() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(RANKS), "rb") as f:
        return f.read()


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(added)))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    captures = warc.assemble(warc.read_records(spark, path, payloads=False))
    flat = captures.select("capture_id", F.col("metadata.page_id").alias("page_id"), F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"), F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("target"))
    # archives are read once; only revisits look up the page of their response
    flat = materialize(flat, "captures")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    target = flat.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"))
    first = flat.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    again = flat.where("record_type = 'revisit'").join(target, "target", "left")
    return first.select(*columns).unionByName(again.select(*columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def _predicted(scores: DataFrame, folds: tuple[int, int], threshold: float) -> DataFrame:
    return scores.select("doc_id", (fold("doc_id", folds[0]) == folds[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return _predicted(quality_classifier.score(docs, model), quality_classifier.HELD_OUT, 0.5)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.predict(docs, language_id.train(docs))
    parts, part = language_id.HELD_OUT
    return out.select("doc_id", (fold("doc_id", parts) == part).alias("held_out"), "lang_pred", "score", "rejected")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_rules.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_rules.apply_rules(docs, forest)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return _predicted(toxicity.score(docs, model), toxicity.HELD_OUT, 0.3)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), near_dup.NearDup(shingle=2, percent=80))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), rank_bytes())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_warc, op3_line_dedup, op4_quality_classifier, op5_language_id, op6_quality_rules, op7_toxicity, op8_benchmark_decontamination, op9_minhash_near_dedup, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over whole tables. op4 to op7 are learned, op9 is a closure over verified links, op10 is a tokenizer: none."""
    b32 = " || ".join(f"substr('{warc.BASE32}', (('0x' || substr(h, {1 + 5 * (k // 4)}, 5))::bigint >> {15 - 5 * (k % 4)}) % 32 + 1, 1)" for k in range(32))
    control = CONTROL_TEXT.replace("'", "''")

    def formatted(col: str, newlines: bool) -> str:
        """Code points of a column in the template: one more for each backslash, each place where a control string begins and, in roles, each newline."""
        marks = f"list_sum(list_transform(regexp_extract_all({col}, '#{{3,}}'), lambda m: length(m) - 2))"
        extra = f" + length({col}) - length(replace({col}, chr(10), ''))" if newlines else ""
        return f"length({col}) + length({col}) - length(replace({col}, '\\', '')) + coalesce({marks}, 0) + (length({col}) - length(replace({col}, '</turn>', ''))) // 7{extra}"

    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op1_chat_format": f"""
            WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
                       UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '{control}' FROM range(2) x(t))
            SELECT conv_id::bigint AS conv_id, count(*)::bigint AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum({len(chat_format.HEADER + chat_format.ROLE_END + chat_format.TURN_END)} + {formatted("role", True)} + {formatted("text", False)})::bigint AS formatted_chars
            FROM r GROUP BY conv_id""",
        "op8_benchmark_decontamination": f"""
            WITH i AS (SELECT item_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{word}') AS w FROM benchmark WHERE item_id IS NOT NULL),
            t AS (SELECT item_id, w, least(len(w), {decontamination.WINDOW}) AS m FROM i WHERE len(w) > 0),
            q AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS win FROM t, unnest(range(1, len(w) - m + 2)) x(p)),
            d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{word}') AS w FROM documents WHERE doc_id IS NOT NULL),
            s AS (SELECT r, m, p, array_to_string(w[p : p + m - 1], ' ') AS win FROM d, (SELECT DISTINCT m FROM t), unnest(range(1, len(w) - m + 2)) x(p)),
            f AS (SELECT r, q.m, p, item_id FROM s JOIN q ON s.win = q.win AND s.m = q.m),
            h AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM f, unnest(range(m)) y(k) GROUP BY r),
            n AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar)) AS sha FROM f GROUP BY r)
            SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
                   coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)""",
        "op2_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages WHERE page_id IS NOT NULL),
            f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
            SELECT page_id, strlen(p.payload)::bigint AS payload_bytes, {b32} AS payload_digest,
                   CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN first < page_id THEN first END AS refers_to
            FROM p JOIN f ON p.payload = f.payload""",
        "op3_line_dedup": f"""
            WITH d AS (SELECT doc_id, source AS host, text, string_split(text, chr(10)) AS lines FROM documents),
            l AS (SELECT doc_id, host, unnest(lines) AS line FROM d),
            c AS (SELECT host, trim(line, ' ') AS k, count(DISTINCT doc_id) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
            t AS (SELECT host, count(*) AS n FROM d GROUP BY host),
            b AS (SELECT c.host, list(k) AS bad FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE pages >= {line_dedup.MIN_PAGES} AND pages > n * {line_dedup.MAX_RATIO} GROUP BY c.host),
            k AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, trim(x, ' ')), false)) AS kept FROM d LEFT JOIN b ON d.host IS NOT DISTINCT FROM b.host)
            SELECT doc_id, len(lines)::bigint AS n_lines, (len(lines) - len(kept))::bigint AS n_dropped,
                   length(array_to_string(kept, chr(10)))::bigint AS n_chars_kept, sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM k""",
    }
