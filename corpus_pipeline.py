"""The corpus pipeline: five stages from raw documents to token digests.

Each stage takes what its predecessor kept, from Parquet, and returns the columns of
``documents``; the last returns digests of the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosea.llm import bpe, langid, mixing, near_dup, toxicity
from mnemosea.llm._common import crc_mod, materialise, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no learnt language, go; null and empty texts have no letter. If no row has a
    language, all stay. Repeated rows share their fate."""
    return langid.keep_identified(docs, langid.fit(docs, crc_mod(F.col("doc_id"), 3) != 1))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Null and empty texts are scored as texts without features; without
    labels of both kinds the score is the share of toxic labels. Repeated rows share their fate."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest doc_id stays. Texts without words stay
    alone; a row that repeats doc_id and text stays once; rows without doc_id are copies only of each other."""
    return near_dup.keep_one_of_each(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them. Null sources are one source, texts without words add nothing and are taken like
    others; rows that repeat doc_id and text share what they are given."""
    return mixing.repeated_as_mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document, and of every copy; null texts are empty, and empty ones have no tokens."""
    return bpe.digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("near-duplicates", deduplicate),
    ("mixing", mix),
    ("BPE", encode),
]

#: Language ID, toxicity, sampling by Spark's hashes and BPE have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
