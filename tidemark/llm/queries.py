"""The queries opN_<name>, each its operator over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import centroids
from tidemark.llm.alignment import align
from tidemark.llm.common import table
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.language_id import identify
from tidemark.llm.packing import pack
from tidemark.llm.pii import find_pii
from tidemark.llm.prefix_bpe import encode_decode
from tidemark.llm.quality import score_quality
from tidemark.llm.secret_scan import scan_secrets
from tidemark.llm.substring_dedup import dedup_substrings
from tidemark.llm.token_store import token_store


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), window=35)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_near_items")


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents")).documents.drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality_rules,
        op3_secret_scan,
        op4_pii,
        op5_exact_dedup,
        op6_best_fit_packing,
        op7_substring_dedup,
        op8_ngram_jaccard_join,
        op9_token_store,
        op10_decontamination,
        op11_prefix_bpe,
        op12_centroid_clustering,
        op13_tokenizer_alignment,
    )
}

ORACLE_SQL = {
    "op12_centroid_clustering": centroids.sql(),
    "op5_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)
    """,
    "op10_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), asked AS (
            SELECT DISTINCT item_id, w[i : i + least(len(w), 10) - 1] AS words, least(len(w), 10) AS n
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0
        ), placed AS (
            SELECT doc_id, n, i, w[i : i + n - 1] AS words
            FROM d, (SELECT DISTINCT n FROM asked) AS s, unnest(range(1, len(w) - n + 2)) AS r(i)
        ), found AS MATERIALIZED (
            SELECT doc_id, i, p.n, item_id FROM placed AS p JOIN asked AS a ON p.words = a.words AND p.n = a.n
        ), hit AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS r(k) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), placed AS MATERIALIZED (
            SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS words FROM d, unnest(range(1, len(w) - 33)) AS r(i)
        ), repeats AS (
            SELECT doc_id, i FROM placed QUALIFY count(*) OVER (PARTITION BY words) > 1
        ), gone AS MATERIALIZED (
            SELECT DISTINCT doc_id, k FROM repeats, unnest(range(i, i + 35)) AS r(k)
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text
            FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) AS a
            WHERE NOT EXISTS (SELECT 1 FROM gone AS g WHERE g.doc_id = a.doc_id AND g.k = a.k)
            GROUP BY doc_id
        ), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}
