"""Corpus pipeline: quality classifier, line dedup, near-dedup, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before kept; its result is
written as Parquet and read again as the next stage's documents. All but the last return the columns
of ``documents``; the last returns the mix as token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnspark.llm import bpe, cube, line_templates, near_dedup, quality
from tarnspark.llm.common import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return quality.accepted(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut out; documents left without a word go."""
    return line_templates.deduplicated(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id."""
    return near_dedup.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the balanced mix takes it."""
    return cube.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every document of the mix."""
    return bpe.encode_documents(docs, "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_recurring_lines),
    ("near dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("tokenisation", encode),
]

#: The classifier, the minhashes and the cube's draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
