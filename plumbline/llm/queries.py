"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fst_tokenizer, language_id, packing, secret_scan, simhash, token_counts, token_store, toxicity, vp_ann
from .common import fresh_path, held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    found = secret_scan.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    counts = [secret_scan.count_of("base_spans", k).alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed("base_spans"), 256).alias("base_sha256"), secret_scan.listed("all_spans").alias("spans"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, fst_tokenizer.default_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, fst_tokenizer.default_path(), end_id=2)
    return token_store.summary(token_store.read(spark, path))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20, factor=1.0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.assign(table(spark, sf_dir, "documents"), radius=3, words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    return language_id.with_language(docs.drop("lang"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), fst_tokenizer.default_path(), end_id=1, window=2048)


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_secret_scan,
        op3_token_counts,
        op4_token_store,
        op5_nearest,
        op6_simhash,
        op7_language_id,
        op8_packing,
        op9_chat_rotation,
        op10_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_nearest": """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op9_chat_rotation": """
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker NOT IN ('system', 'unknown')),
each AS (
  SELECT b.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = p.perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM base b JOIN people p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (SELECT *, '<|' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || replace(replace(translate(speaker, chr(13) || chr(10), '  '), '<|', '< |'), '|>', '| >') ELSE '' END || '|>' || chr(10) AS head FROM each),
piece AS (SELECT *, head || content || '<|end|>' || chr(10) AS rendered FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM piece)
SELECT conv_id, perspective, turn, chat_role, rendered, start, start + length(rendered) AS "end",
  CASE WHEN chat_role = 'assistant' THEN start + length(head) END AS train_start,
  CASE WHEN chat_role = 'assistant' THEN start + length(rendered) - 1 END AS train_end
FROM placed""",
}
