"""The registered queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import (
    bpe,
    decontaminate,
    divergence,
    hilbert,
    jaccard,
    langid,
    licenses,
    nn_descent,
    oracles,
    quality,
    repeats,
    secrets,
    spelling,
    token_store,
)
from muster.llm.common import scratch, table
from muster.llm.registry import ORACLE, QUERIES, query  # noqa: F401


@query("op1_quality_subword")
def op1_quality_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        quality.accepted().cast("int").alias("predicted"))


@query("op2_nn_descent", oracles.NEAR_VECTORS)
def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_hilbert_shards")
def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.place(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op9_bpe_round_trip")
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op10_token_store")
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the store, look every document up in its index, read its ids from the shards."""
    docs = table(spark, sf_dir, "documents")
    store = token_store.TokenStore.write(docs, scratch(spark, "token-store"))
    found = store.lookup(token_store.every_copy(docs), copy_col="copy")
    return store.fetch(found).select(F.col("id").alias("doc_id"), "start", "n_tokens",
                                     F.crc32("ids").alias("ids_crc32"))


@query("op4_signature_trees", oracles.NEAR_DOCUMENTS)
def op4_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), k=4, percent=85)


@query("op5_language_fusion")
def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), model)


@query("op6_randomness_secrets")
def op6_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op7_license_diagonals")
def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op8_spaced_seeds", oracles.BENCHMARK_PASSAGES)
def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_source_divergence", oracles.SOURCE_DIVERGENCE)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants", oracles.SPELLING_VARIANTS)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


@query("op12_repeated_passages", oracles.REPEATED_PASSAGES)
def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.scan(table(spark, sf_dir, "documents"))
