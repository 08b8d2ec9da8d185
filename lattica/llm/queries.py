"""The ten queries opN_<name>, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import covertree, matroska, mixing, neardup, packing, pii, quality, sharding, token_counts, toxicity

GPT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_documents(spark, sf_dir), _labels(spark, sf_dir), of=3, held=1)


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), shards=24)


def op3_sentence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), _labels(spark, sf_dir), of=5, held=0)


def op4_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50, scale=256)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_documents(_documents(spark, sf_dir)).drop("media")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), GPT_VOCABULARY, capacity=2048, end=0)


def op8_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), GPT_VOCABULARY)


QUERIES = (
    op1_attention_quality,
    op2_ring_sharding,
    op3_sentence_toxicity,
    op4_dual_tree_search,
    op5_source_mix,
    op6_matroska,
    op7_best_fit_packing,
    op8_minhash_components,
    op9_personal_data,
    op10_token_counts,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


SEARCH_SQL = """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op4_dual_tree_search": SEARCH_SQL}
