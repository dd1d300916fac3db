"""The registered queries of this subpackage: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinreel.llm import decontaminate, html_text, lm_score, mixing, sharding, simhash, spotsigs, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # early weight falls for every third source, is even for the next and rises for the last
    curriculum = (((0, 3), (1, 1)), ((0, 1), (1, 1)), ((0, 1), (0.5, 1), (1, 4)))
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_repeats=2.0, schedules=curriculum)
    return mixing.by_position(mixed).select("doc_id", "size", "source_size", "target", "taken", "position")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(_table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_on(docs, _table(spark, sf_dir, "labels")))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spotsigs.compare_with_next(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_mix_sources, op2_html_text, op3_warc_index, op4_histogram_shards, op5_url_filter, op6_lm_score, op7_simhash_components, op8_toxicity, op9_spotsigs, op10_decontaminate, pipeline]
    return {f.__name__: f for f in ops}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_index": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
            q AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS d FROM p),
            r AS (SELECT d, max(page_id) AS last FROM q WHERE n >= 1000 GROUP BY d)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
                   CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN last <> page_id THEN last END AS refers_to
            FROM q LEFT JOIN r USING (d)""",
        "op10_decontaminate": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
            b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
            w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS win
                  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0),
            k AS (SELECT DISTINCT n FROM w),
            dw AS (SELECT doc_id, k.n, i, array_to_string(ws[i:i + k.n - 1], ' ') AS win
                   FROM d, k, unnest(range(1, len(ws) - k.n + 2)) AS t(i) WHERE len(ws) >= k.n),
            h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN w USING (n, win)),
            p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
            s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
                   CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
                   coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)""",
    }
