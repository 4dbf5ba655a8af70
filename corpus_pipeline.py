"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents; the last returns where each piece of each document is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallweave.llm import chunkdedup, langid, mixing, neardup, packing
from recallweave.llm.common import settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or with too few known n-grams go."""
    return langid.in_a_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, likeness of 0.8 or more."""
    return neardup.one_of_each(docs, words_in_shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in an earlier one."""
    return chunkdedup.remove_repeated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of each document, so that sources weigh as the square root of their mass."""
    return mixing.replicate(docs, exponent=0.5, copy="__rw_copy", copies="__rw_copies").select(*docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and slot of each piece; copies of a document never share a bin."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_bins", pack_bins),
]

#: The stages hash, learn and search; SQL can't express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
