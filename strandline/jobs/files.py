"""Jobs that write documents' sequences in file formats, or as indexes, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.operators import kept
from strandline.sources import formats
from strandline.sources.tables import scratch, table

from .common import DNA, reference, windows_sql
from .indexes import _BWT3, _sa


def fasta_round_trip(spark, d):
    path = scratch(spark, "fasta")
    lines = formats.fasta_lines(reference(spark, d).select(F.col("seq_id").alias("record_no"), F.concat(F.lit("s"), F.col("seq_id").cast("string"), F.lit(" of the documents")).alias("header"), F.col("dna").alias("seq")), 60)
    lines.repartitionByRange("record_no").sortWithinPartitions("record_no", "line_no").select("line").write.text(path)
    return formats.read_fasta(spark, path).select("name", "header", "seq")


def fastq_round_trip(spark, d):
    path = scratch(spark, "fastq")
    ref = reference(spark, d).where("dna <> ''")
    ref.select(F.concat_ws("\n", F.concat(F.lit("@r"), F.col("seq_id").cast("string")), "dna", F.lit("+"), F.regexp_replace("dna", ".", "I"))).write.option("compression", "gzip").text(path)
    return formats.read_fastq(spark, path).select("name", "seq")


def genbank_round_trip(spark, d):
    path = scratch(spark, "genbank")
    spaced = F.trim(F.regexp_replace(F.lower("dna"), "(.{10})", "$1 "))
    ref = reference(spark, d)
    ref.select(F.concat(F.lit("LOCUS       s"), F.col("seq_id").cast("string"), F.lit("\nORIGIN\n        1 "), spaced, F.lit("\n//"))).write.text(path)
    meta, sequence = formats.genbank(F.col("content"))
    return formats.read_entries(spark, path).select(F.regexp_extract(meta, r"LOCUS\s+(\S+)", 1).alias("name"), F.upper(sequence).alias("seq"))


def index_round_trip(spark, d):
    path = scratch(spark, "index")
    kept.build_suffixes(reference(spark, d), "dna", "seq_id", path, 3)
    return kept.open_suffixes(spark, path, 3)["suffixes"].select("seq_id", "rank", "pos", "bwt", "occ_a", "occ_c", "occ_g", "occ_t")


def gram_index(spark, d):
    """Places of parts' first three letters of DNA, found in a written index of 8-grams, in order."""
    path = scratch(spark, "grams")
    kept.build_grams(reference(spark, d), "dna", "seq_id", path, 8)
    patterns = table(spark, d, "part").select(F.left(seq.normalize(F.col("p_name"), "keep_upper"), F.lit(3)).alias("pattern")).where("pattern <> ''").distinct()
    found = kept.ordered_places(kept.find_grams(kept.open_grams(spark, path, 8), patterns), "seq_id")
    return found.select("pattern", "seq_id", F.size("places").cast("long").alias("n"), F.concat_ws(",", F.transform(F.slice("places", 1, 20), lambda p: p.cast("string"))).alias("places"))


JOBS = {
    "fasta_round_trip": (fasta_round_trip, f"WITH {DNA} SELECT 's' || seq_id AS name, 's' || seq_id || ' of the documents' AS header, dna AS seq FROM reference"),
    "fastq_round_trip": (fastq_round_trip, f"WITH {DNA} SELECT 'r' || seq_id AS name, dna AS seq FROM reference WHERE dna <> ''"),
    "genbank_round_trip": (genbank_round_trip, f"WITH {DNA} SELECT 's' || seq_id AS name, dna AS seq FROM reference"),
    "index_round_trip": (index_round_trip, f"WITH {DNA}, {_sa(3)}, {_BWT3} SELECT seq_id, rank, pos, bwt, " + ", ".join(f"(sum((bwt = '{b}')::BIGINT) OVER (PARTITION BY seq_id ORDER BY rank))::BIGINT AS occ_{b.lower()}" for b in "ACGT") + " FROM bwt"),
    "gram_index": (gram_index, f"WITH {DNA}, n AS (SELECT DISTINCT left(regexp_replace(translate(p_name, 'acgtn', 'ACGTN'), '[^ACGT]', '', 'g'), 3) AS pattern FROM part), w AS ({windows_sql(8)}) SELECT pattern, seq_id, count(*) AS n, array_to_string(list_sort(list(pos))[1:20], ',') AS places FROM n JOIN w ON left(gram, length(pattern)) = pattern WHERE pattern <> '' GROUP BY 1, 2"),
}
