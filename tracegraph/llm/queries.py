"""Registered queries of the training-data operators: one thin digest query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import simhash

    return simhash.digests(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import suffix

    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=50, keep=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op5_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import pii

    return pii.digests(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import toxicity

    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import warc

    return warc.digests(table(spark, sf_dir, "pages"), min_bytes=0)


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import media

    return media.text_media(table(spark, sf_dir, "documents"), keep_media=False)


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegraph.llm import tokencount

    return tokencount.token_counts(table(spark, sf_dir, "documents"), limit=512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nra_topk": op1_nra_topk,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_pii_anchors": op5_pii_anchors,
    "op6_toxicity": op6_toxicity,
    "op7_warc_zip": op7_warc_zip,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_bpe_trie": op9_bpe_trie,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_nra_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_warc_zip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM h),
        d AS (
            SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c:
                substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', c) - 3, 4)), '') AS bits FROM f)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_transform(string_split(substr(bits, CAST(5 * i + 1 AS BIGINT), 5), ''), lambda c: CAST(c AS INTEGER)), lambda a, c: a * 2 + c) AS INTEGER), 1)), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM d""",
    "op3_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        c AS (SELECT doc_id, n, 500 * k AS base, substr(h, 1000 * k + 1, 1098) AS c FROM (SELECT doc_id, h, n, unnest(range(0, (n - 50) // 500 + 1)) AS k FROM d WHERE n >= 50)),
        w AS (SELECT doc_id, base + q AS p, substr(c, 2 * q + 1, 100) AS s FROM (SELECT doc_id, base, c, unnest(range(0, least(500, n - 49 - base))) AS q FROM c)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
        hit AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.s = f.s WHERE f.first < w.doc_id),
        mark AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
        run AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM mark),
        span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k),
        gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM span),
        cut AS (
            SELECT g.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
            FROM gap g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id""",
}
