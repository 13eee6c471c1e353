"""Preparation of a training corpus: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from offerlens.llm import bpe, lines, mixing, quality, simhash
from offerlens.llm.storage import kept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers in their language and source. Null, empty and short texts fail the rules;
    null languages and sources are groups of their own; repeated rows fare alike; an empty table gives an empty result."""
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines whose templates recur across documents. n_chars stays the input's. Null texts stay null, empty
    ones empty; long texts are read whole; repeated rows lose the same lines; an empty table gives an empty result."""
    return lines.without_recurring(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at a similarity of 0.8 over five-word shingles. Null and empty texts are one
    group; rows with a null id stay; of rows that repeat an id one stays; an empty table gives an empty result."""
    return simhash.one_of_each_group(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: up to twice. Null and empty texts add no words and come as often as their hash
    says; a null source is one of its own; repeated rows come equally often; an empty table gives an empty result."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its token ids (little-endian unsigned 32-bit integers), and the digests of these and of the text
    decoded from them. Null and empty texts have no ids; repeated rows stay; an empty table gives an empty result."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: SQL has neither the fingerprints nor the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
