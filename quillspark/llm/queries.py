"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, classifier, html, mixing, rules, sharding, simhash, topk, urlfilter, warc
from quillspark.session import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights, _, _ = classifier.fit(docs)
    scored = classifier.with_quality(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", F.round("quality_score", 6).alias("quality_score"), (F.col("quality_score") >= 0.5).alias("kept"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, urlfilter.RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_index(spark, path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"), n_shards=40)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.with_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.with_rules(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", *(F.col(f"rules.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


@lru_cache(maxsize=1)
def vocabulary() -> bpe.Vocabulary:
    """The contract's vocabulary, built once a process: its tables take memory of the driver."""
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.with_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return docs.select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.decoded_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draws(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_quality_classifier, op3_url_filter, op4_top_k, op5_warc, op6_sharding, op7_html_text, op8_quality_rules, op9_byte_bpe, op10_mixing)}

_RULE_ROWS = "('com/en/','block','com','/en/'), ('example.com/en/7','allow','example.com','/en/7'), ('net/de/','block','net','/de/'), ('example.net/de/8','block','example.net','/de/8'), ('org/es/','block','org','/es/')"

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": f"""
        WITH rules(rule, action, rule_host, rule_path) AS (VALUES {_RULE_ROWS}),
        cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id,
              translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        addresses AS (SELECT DISTINCT host, path FROM parts),
        hits AS (SELECT host, path, rule, action,
              row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, length(rule_host) DESC, rule) AS n
            FROM addresses JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.action, 'allow') AS verdict
        FROM parts p LEFT JOIN hits h ON p.host = h.host AND p.path = h.path AND h.n = 1
    """,
    "op4_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN owner END AS refers_to
        FROM d
    """,
}
