"""The registered queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark_leaks, ordinal_quality, piece_bpe, simhash_dedup, toxicity_chain, two_pass_shards, url_rules, voronoi_topk, warc_archive, word_bpe_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_archive.write_archive(table(spark, sf_dir, "pages"))
    return warc_archive.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_chain.judge(docs, toxicity_chain.fit(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return two_pass_shards.digest(two_pass_shards.read_shards(spark, two_pass_shards.write_shards(docs), docs))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True).drop("row")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_quality.judge(docs, ordinal_quality.fit(docs, table(spark, sf_dir, "labels")))


def url_host_path_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 9 that is no mining: host, path and fixed rule of every url, and that rule's verdict."""
    return url_rules.prepare(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", F.col("label").alias("fixed_verdict"))


def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6's law and losslessness: rows, slots and bytes of every shard and of all."""
    found = op6_sharding(spark, sf_dir)
    each = found.groupBy("shard").agg(F.count("*").alias("rows"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    whole = found.agg(F.sum("size").alias("bytes"), F.count_distinct("doc_id").alias("documents"))
    return each.crossJoin(whole)  # one row


def token_count_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 3 that SQL can express."""
    return op3_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") > word_bpe_count.LIMIT).alias("over"), "over_limit").select("doc_id", "n_bytes", (F.col("over") == F.col("over_limit")).alias("agrees"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_sentencepiece, op3_token_counts, op4_simhash, op5_toxicity, op6_sharding, op7_decontamination, op8_topk, op9_url_filter, op10_quality, url_host_path_rule, shard_totals, token_count_bytes)
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d, row_number() OVER (PARTITION BY sha256(coalesce(html, '')) ORDER BY page_id NULLS LAST) AS r FROM pages),
        g AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN r > 1 AND p.page_id IS NOT NULL AND g.d IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN r > 1 AND p.page_id IS NOT NULL AND g.d IS NOT NULL THEN g.first_id END AS refers_to
        FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 100""",
    "url_host_path_rule": """
        WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS t FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(rh, rp, verdict)),
        fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT h.page_id, host, path, rule, verdict AS fixed_verdict FROM h LEFT JOIN fit USING (page_id)""",
    "shard_totals": """
        WITH n AS (SELECT count(*) AS n, CAST(sum(coalesce(strlen(text), 0) + 16) AS BIGINT) AS bytes, count(DISTINCT doc_id) AS documents FROM documents)
        SELECT CAST(i AS INTEGER) AS shard, n * (i + 1) // 40 - n * i // 40 AS rows, CAST(0 AS BIGINT) AS first, n * (i + 1) // 40 - n * i // 40 - 1 AS last, n * (i + 1) // 40 - n * i // 40 AS slots, bytes, documents
        FROM n, range(40) AS t(i) WHERE n * (i + 1) // 40 > n * i // 40""",
    "token_count_bytes": "SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, true AS agrees FROM documents",
    "op8_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
