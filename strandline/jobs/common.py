"""The inputs that jobs share: DNA of the documents, and simulated reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.operators import align
from strandline.sources.tables import table

PERIOD, SEED_LENGTH, READ_LENGTH, READ_STEP = 3, 12, 36, 97


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, dna: the letters A, C, G, T of every document's upper-cased text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.coalesce(seq.normalize(F.col("text"), "keep_upper"), F.lit("")).alias("dna"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads taken from the documents at every READ_STEP-th position."""
    return align.simulated(reference(spark, sf_dir), READ_LENGTH, READ_STEP, PERIOD)


DNA = "reference AS (SELECT doc_id AS seq_id, coalesce(regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGT]', '', 'g'), '') AS dna FROM documents)"


def windows_sql(size: int, source: str = "reference", text: str = "dna", key: str = "seq_id") -> str:
    return f"SELECT {key}, p AS pos, substr({text}, p + 1, {size}) AS gram FROM (SELECT {key}, {text}, unnest(range(0, length({text}) - {size} + 1)) AS p FROM {source})"
