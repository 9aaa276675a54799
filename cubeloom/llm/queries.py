"""One query for each operator of this subpackage, over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import langid, merkle, mixing, packing, partenum, quality, secrets, sharding, tokenfiles, toxicity
from cubeloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_digests(spark, table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit(docs))


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).withColumn("mix_rate", F.round("mix_rate", 9))


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        sharding.row_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join_documents(table(spark, sf_dir, "documents"))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_language_id": op2_language_id,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_trees": op5_quality_trees,
    "op6_poisson_mixture": op6_poisson_mixture,
    "op7_histogram_sort": op7_histogram_sort,
    "op8_secret_links": op8_secret_links,
    "op9_partenum_join": op9_partenum_join,
    "op10_ordinal_toxicity": op10_ordinal_toxicity,
}

ORACLES: dict[str, str] = {
    "op6_poisson_mixture": mixing.ORACLE,
    "op9_partenum_join": partenum.ORACLE,
}
