"""What the operators of this subpackage share: table reading, written tables, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandline.sources.code import ship
from strandline.sources.tables import scratch, table

__all__ = ["binaries", "bucketed", "pieces", "rows", "scratch", "ship", "stored", "table", "values", "widened"]


def stored(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage is cut and survives lost executors."""
    path = scratch(df.sparkSession, label)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def binaries(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string or binary column as bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()) if not pa.types.is_binary(column.type) else column
    return [x or b"" for x in column.to_pylist()]


def pieces(batch: pa.RecordBatch, name: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows, so that a string or binary column has about size bytes in a piece, and one row at least."""
    ends = np.cumsum([0, *(n or 0 for n in pc.binary_length(batch.column(batch.schema.get_field_index(name))).to_pylist())])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch from one list or array per field."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def widened(df: DataFrame, **added: str) -> T.StructType:
    """df's schema with columns added, by name and type."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items())])


def bucketed(df: DataFrame, label: str, column: str, buckets: int, codec: str = "none") -> DataFrame:
    """Like stored(), as a table bucketed by column: a join on it with the same number of partitions moves only the other side."""
    name = f"strandline_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch(df.sparkSession, label)).option("compression", codec).bucketBy(buckets, column).saveAsTable(name)
    return df.sparkSession.table(name)
