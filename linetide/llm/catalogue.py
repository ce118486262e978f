"""One thin query per operator, over the whole tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language_id, packing, secret_scan, simhash, token_counts, topk, toxicity, vector_dedup
from .frames import table

#: A conversation whose texts spell out marks of chat formats.
MARKS = r"\### Assistant: </turn> ok"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return language_id.classify(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and component of every vector."""
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that spells out marks, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    return chat.read_back(chat.format_chats(rows.union(marks.coalesce(1))), ordered=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    own = (op1_token_counts, op2_toxicity, op3_language_id, op4_secret_scan, op5_best_fit_packing, op6_embedding_dedup, op7_bpe, op8_exact_topk, op9_chat_format, op10_simhash)
    return {f.__name__: f for f in own}


CHAT_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
    SELECT *, replace(replace(role, '\', '\\'), '<|', '\l|') AS r, replace(replace(text, '\', '\\'), '<|', '\l|') AS t FROM rows
), formatted AS (
    SELECT *, '<|turn|>' || CASE WHEN ends_with(r, '<') THEN r[:-2] || '\l' ELSE r END || '<|text|>' || CASE WHEN ends_with(t, '<') THEN t[:-2] || '\l' ELSE t END || '<|end|>' || chr(10) AS formatted FROM escaped
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars,
    CAST(0 AS BIGINT) AS n_attachments,
    CAST(0 AS BIGINT) AS expanded_tokens
FROM formatted GROUP BY conv_id
"""


TOPK_SQL = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, len(embedding) AS dims FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
    SELECT a.vec_id AS query_id, a.n AS query, b.vec_id,
        CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.n <> b.n AND a.dims = b.dims
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op8_exact_topk": TOPK_SQL, "op9_chat_format": CHAT_SQL}
