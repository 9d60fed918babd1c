"""One query per operator: it reads its table, applies the operator and derives the reported columns."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, filter_audit, jaccard_join, licenses, mixing, packing, quality_rules, token_files, token_links, top_inner, toxicity, url_rules, weak_labels
from .oracles import ORACLE_SQL
from .shared import ship, table

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.train_and_score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc.doc_id", "toxicity").select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) as bigint)")
    return url_rules.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, number)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc.doc_id", *quality_rules.COUNTS, "base_failed", "loss", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sizes(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op7_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner.search_table(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.link(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def _shipping(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


NUMBERED = (
    op1_token_files, op2_byte_bpe, op3_toxicity, op4_url_rules, op5_quality_rules, op6_mixing, op7_weak_labels, op8_jaccard_join, op9_licenses, op10_top_inner,
    op11_filter_audit, op12_packing, op13_token_links,
)
QUERIES = {f.__name__: _shipping(f) for f in NUMBERED}
