"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns they were given, whatever those are
called besides the columns of documents.

Null and empty texts pass every stage: they are not toxic, have no near copies and no secrets, and are packed as
the end id alone. Very long texts are worked on whole. Rows of one doc_id are documents of their own, but of
copies, those of one doc_id included, one row stays. Ties are settled as the operators' docstrings say. An empty
table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubeloom.llm import mixing, packing, partenum, secrets, toxicity
from cubeloom.llm.common import stage, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression calls toxic go; the others stay as they are."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return partenum.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each finding in their texts becomes a mark."""
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, as their source's target weight asks for, and shuffled."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near duplicates", remove_near_copies),
    ("secrets", hide_secrets),
    ("mixture", mix),
    ("packing", pack),
]

#: SQL cannot express the trained, similarity-joined and tokenised stages; tests compare them with plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
