"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import fingerprint, mixing, neardup, neighbours, packing, pii, secrets, sharding, toxicity, urls
from tidelog.llm.common import table

#: Words in a shingle, as the query's contract has it; the operator's own default is five.
OP2_SHINGLE = 4


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=OP2_SHINGLE)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # texts without words are clustered where they are equal; words are counted where they are hashed, and texts read once
    docs = docs.select("doc_id", "source", "text", F.when(F.col("text").isNotNull(), F.concat(F.lit("equal "), F.xxhash64("text"))).alias("_equal"))
    near = neardup.near_duplicates(docs, also=("source", "_equal"))
    return packing.pack(near, cluster=F.coalesce(F.concat(F.lit("near "), F.col("comp")), F.col("_equal")), words=F.col("n_words"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_minhash_near_dedup, op3_toxicity, op4_best_fit_packing, op5_pii, op6_secrets, op7_nearest_neighbours, op8_fingerprints, op9_mixing, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": urls.judge_sql()}
