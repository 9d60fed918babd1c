"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing, tokens.

Each stage takes all documents that its predecessor kept. Stages keep, drop or repeat whole rows and return the columns
of documents; the last returns a row of digests per document. Rows with null text fail the quality rules; rows with a
null doc_id can't be near duplicates and stay; extra columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import byte_bpe, jaccard_join, mixing, quality_rules, toxicity
from strandline.llm.shared import ship, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.judge(docs, tuple(docs.columns)).where("kept").select("doc.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.train_and_score(docs, table(spark, sf_dir, "labels"), tuple(docs.columns))
    return scored.where(F.col("toxicity") < toxicity.THRESHOLD).select("doc.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emitted(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("clean", clean), ("distinct", distinct), ("mixed", mixed), ("tokens", tokens)]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
