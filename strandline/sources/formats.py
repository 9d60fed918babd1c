"""Sequence file formats as DataFrames.

Spark cuts files at record separators (or lines) and reads their splits side by side; a record's number in its file comes
from ranges of splits. Compressed files are one split each, but still read record by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.streams import counter

from .tables import stored


def guess_format(content: Column) -> Column:
    """fasta, genbank, embl or raw, by the first character."""
    first = F.substring(content, 1, 1)
    return F.when(first == ">", "fasta").when(first == "L", "genbank").when(first == "I", "embl").otherwise("raw")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, content: whole files, for formats without records."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, split, at, value: what lies between separators; split and at order a file's rows."""
    rows = spark.read.text(path, lineSep=separator)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows (file, split, at and others) with their number in the file, from 0."""
    placed = stored(counter(rows, "file", "split", "at"), "records")
    first = placed.groupBy("file").agg(F.min("ord").alias("first"))
    return placed.join(first, "file").withColumn(name, (F.col("ord") - F.col("first")).cast("int")).drop("split", "at", "ord", "first")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, record_no, name (first word of the header), header, seq; sequences may span lines, and lines before the first header are left out."""
    cut = _records(spark, path, "\n>")
    # only a file's first piece still has its sign
    starts = (F.col("split") > 0) | F.startswith("value", F.lit(">")) | (F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) > 1)
    kept = cut.where("value <> ''").withColumn("starts", starts).where("starts").withColumn("record", F.regexp_replace("value", "^>", "")).drop("starts", "value")
    header = F.regexp_extract("record", r"^[^\r\n]*", 0)
    sequence = F.regexp_replace(F.expr("substring(record, length(regexp_extract(record, '^[^\\\\r\\\\n]*', 0)) + 1)"), r"\s", "")
    return _numbered(kept, "record_no").select("file", "record_no", F.regexp_extract(header, r"^\s*(\S*)", 1).alias("name"), header.alias("header"), sequence.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, record_no, name, seq of four-line records; compressed files are read as they are."""
    lines = _records(spark, path, "\n").withColumn("line", F.rtrim("value", F.lit("\r"))).where("line <> ''").drop("value")
    placed = _numbered(lines, "line_no")
    at = F.col("line_no") % 4
    return placed.groupBy("file", F.floor(F.col("line_no") / 4).cast("int").alias("record_no")).agg(F.max(F.when(at == 0, F.expr("substring(line, 2)"))).alias("name"), F.max(F.when(at == 1, F.col("line"))).alias("seq"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """file, record_no, content of the entries of GenBank or EMBL files, which end with lines of //."""
    cut = _records(spark, path, "\n//").withColumn("content", F.regexp_replace("value", r"^[^\S\n]*\r?\n|^\s+$", "")).where("content <> ''").drop("value")
    return _numbered(cut, "record_no").select("file", "record_no", "content")


def first_records(records: DataFrame) -> DataFrame:
    return records.where("record_no = 0")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).select("file", F.regexp_replace("content", r"[\r\n]", "").alias("seq"))


def genbank(content: Column) -> tuple[Column, Column]:
    """Metadata up to ORIGIN; the sequence after it, without digits and white space, up to the record's end (/)."""
    meta = F.regexp_extract(content, r"(?s)^(.*?)(?=\nORIGIN|$)", 1)
    return meta, F.regexp_replace(F.regexp_extract(content, r"(?s)\nORIGIN[^\n]*\n([^/]*)", 1), r"[0-9\s]", "")


def embl_lines(content: Column, code: str) -> Column:
    """The first block of lines with a two-letter code, without the code, joined by line breaks; null where there is none."""
    block = F.regexp_extract(F.regexp_replace(content, r"(?s)\n/.*$", "\n"), rf"(?:^|\n)({code}   [^\n]*(?:\n{code}   [^\n]*)*)", 1)
    return F.when(block != "", F.regexp_replace(block, rf"(?m)^{code}   ", ""))


def embl_feature(content: Column, key: str) -> Column:
    """The first feature line with the key and its continuation lines, without FT and the blanks before."""
    block = F.regexp_extract(content, rf"(?:^|\n)FT   {key} +([^\n]*(?:\nFT    +[^\n]*)*)", 1)
    return F.when(block != "", F.regexp_replace(block, r"\nFT +", "\n"))


def fasta_lines(records: DataFrame, width: int = 70) -> DataFrame:
    """records: record_no, header, seq. line: a header line and lines of width characters, in order of (record_no, line_no)."""
    wrapped = F.concat(F.array(F.concat(F.lit(">"), F.col("header"))), F.regexp_extract_all("seq", F.lit(f".{{1,{width}}}"), F.lit(0)))
    return records.select("record_no", F.posexplode(wrapped).alias("line_no", "line"))


def write_alignments(alignments: DataFrame, path: str) -> None:
    """Tab-separated read, strand, sequence, position, phase, mismatches."""
    alignments.write.option("sep", "\t").csv(path)
