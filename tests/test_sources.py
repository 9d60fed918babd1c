from strandline.sources import formats
from strandline.streaming import reads as stream


def test_fasta_fastq_raw(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first\nACG\nTT\n>r2\n\nGG\n>empty\n")
    rows = formats.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("record_no").collect()
    assert [(r.name, r.seq) for r in rows] == [("r1", "ACGTT"), ("r2", "GG"), ("empty", "")]
    assert formats.first_records(formats.read_fasta(spark, str(tmp_path / "a.fa"))).first().header == "r1 first"
    (tmp_path / "a.fq").write_text("@q1\nACGT\n+\n!!!!\n@q2\nGG\n+\n!!\n")
    rows = formats.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("record_no").collect()
    assert [(r.name, r.seq) for r in rows] == [("q1", "ACGT"), ("q2", "GG")]
    lines = formats.fasta_lines(formats.read_fasta(spark, str(tmp_path / "a.fa")), 2).orderBy("record_no", "line_no").collect()
    assert [r.line for r in lines] == [">r1 first", "AC", "GT", "T", ">r2", "GG", ">empty"]


def test_genbank_and_embl(spark):
    gb = "LOCUS x\nDEFINITION y\nORIGIN\n   1 acgt acg\n   8 tt\n//\n"
    embl = "ID   x\nDE   one\nDE   two\nFT   gene            1..9\nFT                   /note\nDE   late\n//\n"
    df = spark.createDataFrame([(gb, embl)], "g string, e string")
    meta, sequence = formats.genbank(df["g"])
    row = df.select(meta.alias("m"), sequence.alias("s"), formats.embl_lines(df["e"], "DE").alias("d"), formats.embl_lines(df["e"], "XX").alias("x"), formats.embl_feature(df["e"], "gene").alias("f"), formats.guess_format(df["g"]).alias("k")).first()
    assert row.m.startswith("LOCUS") and row.s == "acgtacgtt" and row.d == "one\ntwo" and row.x is None and row.f == "1..9\n/note" and row.k == "genbank"


def test_read_stream(spark, tmp_path):
    text = "ACGTTGCAAGGCTTACGATCGATTACGGATCCATTTGCA"
    reference = spark.createDataFrame([(0, text)], "seq_id long, dna string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.tsv").write_text(f"7\t{text[2:26]}\n8\t{'T' * 24}\n")
    query = stream.align_stream(stream.read_stream(spark, str(tmp_path / "in")), reference, str(tmp_path / "out"), str(tmp_path / "mark"), 3, 8)
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.read_id, r.pos) for r in rows] == [(7, 2)]
