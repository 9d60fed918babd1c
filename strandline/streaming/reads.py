"""Reads as a stream: files of reads arrive, are aligned against a static reference, and alignments are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import align


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq from files of tab-separated lines that arrive in a folder."""
    return spark.readStream.schema("read_id long, seq string").option("sep", "\t").csv(path)


def align_stream(reads: DataFrame, reference: DataFrame, out: str, checkpoint: str, period: int = 3, length: int = 12):
    """Starts the query: every micro-batch is aligned by the batch operator and written once under its batch number."""

    def batch(rows: DataFrame, number: int) -> None:
        found = align.align_first(rows, reference, period, length)
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
