"""Jobs over online search."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.operators import search
from strandline.sources.formats import guess_format
from strandline.sources.tables import table

from .alignments import READS
from .common import DNA, READ_LENGTH, reads, reference, windows_sql


def find_exact_all(spark, d):
    return search.find_exact(reference(spark, d), "dna", "ACAC", "seq_id")


def find_multi(spark, d):
    """The DNA letters of part names, four or more of them, in the documents' DNA."""
    names = table(spark, d, "part").select(seq.normalize(F.col("p_name"), "keep_upper").alias("pattern")).where(F.length("pattern") >= 4).distinct()
    return search.find_multi(reference(spark, d), "dna", names.withColumn("pattern_id", F.col("pattern")), "seq_id", 4).select("pattern_id", "seq_id", "pos")


def find_wildcard(spark, d):
    return search.find_class(reference(spark, d), "dna", "A[CG].{2}T[AC]", 6, "seq_id")


def edit_pairs_k2(spark, d):
    """Part names of one brand and type within two edits."""
    return search.close_pairs(table(spark, d, "part"), "p_name", "p_partkey", ["p_brand", "p_type"], 2, 6)


def find_approximate(spark, d):
    """Ends of substrings of part names within one edit of a word."""
    return search.find_approximate(table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name")), "name", "ring", 1, "p_partkey")


def swift_filter(spark, d):
    return search.swift_filter(reads(spark, d).select("read_id", "seq"), reference(spark, d), 8, READ_LENGTH, 0.06)


def find_scored(spark, d):
    """Ends in part names that align with a word at a score of 3 or more."""
    return search.find_scored(table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name")), "name", "widget", 3, "p_partkey")


def find_pex(spark, d):
    """Ends in part names within one edit of the first seven letters of a part name."""
    names = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))
    patterns = names.select(F.left("name", F.lit(7)).alias("pattern")).where(F.length("pattern") == 7).distinct().withColumn("pattern_id", F.col("pattern"))
    return search.find_pieces(names, "name", patterns, 1, "p_partkey")


def find_patterns(spark, d):
    """Ends of matches of a pattern with optional, repeated and counted letters in part names."""
    return search.find_wildcards(table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name")), "name", "[a-m]+r?.{1,2}[gt]e*", "p_partkey")


def find_patterns_dna(spark, d):
    """The same in the documents' DNA; counted by document."""
    return search.find_wildcards(reference(spark, d), "dna", "AC?[GT]{2,3}A+", "seq_id").groupBy("seq_id").agg(F.count("*").alias("n"), F.max("end_pos").alias("last"))


def guess_formats(spark, d):
    return table(spark, d, "documents").groupBy(guess_format(F.col("text")).alias("format")).agg(F.count("*").alias("n"))


JOBS = {
    "find_exact_all": (find_exact_all, f"WITH {DNA}, w AS ({windows_sql(4)}) SELECT seq_id, pos FROM w WHERE gram = 'ACAC'"),
    "find_multi": (find_multi, f"WITH {DNA}, n AS (SELECT DISTINCT regexp_replace(translate(p_name, 'acgtn', 'ACGTN'), '[^ACGT]', '', 'g') AS pattern FROM part), w AS (SELECT seq_id, dna, p AS pos, substr(dna, p + 1, 4) AS head FROM (SELECT seq_id, dna, unnest(range(0, length(dna) - 3)) AS p FROM reference)) SELECT pattern AS pattern_id, seq_id, pos FROM n JOIN w ON head = left(pattern, 4) AND substr(dna, pos + 1, length(pattern)) = pattern WHERE length(pattern) >= 4"),
    "find_wildcard": (find_wildcard, f"WITH {DNA}, w AS ({windows_sql(6)}) SELECT seq_id, pos + 5 AS end_pos FROM w WHERE regexp_full_match(gram, 'A[CG].{{2}}T[AC]')"),
    "edit_pairs_k2": (edit_pairs_k2, "SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::INTEGER AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE length(a.p_name) >= 6 AND length(b.p_name) >= 6 AND levenshtein(a.p_name, b.p_name) <= 2"),
    "find_approximate": (find_approximate, "WITH s AS (SELECT p_partkey, name, unnest(range(1, length(name) + 1)) AS e FROM (SELECT p_partkey, lower(p_name) AS name FROM part)), d AS (SELECT p_partkey, e - 1 AS end_pos, least(levenshtein(substr(name, greatest(1, e - 2), least(3, e)), 'ring'), levenshtein(substr(name, greatest(1, e - 3), least(4, e)), 'ring'), levenshtein(substr(name, greatest(1, e - 4), least(5, e)), 'ring'))::INTEGER AS distance FROM s) SELECT * FROM d WHERE distance <= 1"),
    "swift_filter": (swift_filter, f"WITH {READS}, o AS (SELECT read_id, p AS off, substr(seq, p + 1, 8) AS gram FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 7)) AS p FROM reads)), t AS ({windows_sql(8)}), h AS (SELECT read_id, seq_id, pos, off, pos - off AS diagonal FROM o JOIN t USING (gram)), b AS (SELECT read_id, seq_id, pos, off, diagonal >> 4 AS bucket FROM h WHERE diagonal >= 0 UNION ALL SELECT read_id, seq_id, pos, off, -((15 - diagonal) >> 4) FROM h WHERE diagonal < 0 UNION ALL SELECT read_id, seq_id, pos, off, (CASE WHEN diagonal >= 0 THEN diagonal >> 4 ELSE -((15 - diagonal) >> 4) END) - 1 FROM h WHERE ((diagonal % 16) + 16) % 16 < 2), n AS (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY read_id, seq_id, bucket ORDER BY pos, off) >= 31)::INTEGER, 0) AS new FROM b), s AS (SELECT *, sum(new) OVER (PARTITION BY read_id, seq_id, bucket ORDER BY pos, off) AS stretch FROM n) SELECT read_id, seq_id, bucket, count(*) AS hits, min(pos) AS first_pos FROM s GROUP BY read_id, seq_id, bucket, stretch HAVING count(*) >= 13"),
    "find_scored": (find_scored, """WITH RECURSIVE d AS (SELECT p_partkey, lower(p_name) AS name, 0 AS j, [0, -2, -4, -6, -8, -10, -12] AS col FROM part UNION ALL
SELECT p_partkey, name, j + 1, list_transform(range(1, 8), lambda i: list_max(list_transform(range(1, i + 1), lambda k: (CASE WHEN k = 1 THEN 0 ELSE greatest(col[k - 1] + CASE WHEN substr('widget', (k - 1)::INTEGER, 1) = substr(name, j + 1, 1) THEN 1 ELSE -1 END, col[k] - 2) END - 2 * (i - k))::INTEGER))) FROM d WHERE j < length(name))
SELECT p_partkey, (j - 1)::BIGINT AS end_pos, col[7] AS score FROM d WHERE j > 0 AND col[7] >= 3"""),
    "find_pex": (find_pex, """WITH n AS (SELECT p_partkey, lower(p_name) AS name FROM part), p AS (SELECT DISTINCT left(name, 7) AS pattern FROM n WHERE length(name) >= 7), s AS (SELECT p_partkey, name, unnest(range(1, length(name) + 1)) AS e FROM n)
SELECT pattern AS pattern_id, p_partkey, e - 1 AS end_pos, least(levenshtein(substr(name, greatest(1, e - 5), least(6, e)), pattern), levenshtein(substr(name, greatest(1, e - 6), least(7, e)), pattern), levenshtein(substr(name, greatest(1, e - 7), least(8, e)), pattern))::INTEGER AS distance FROM s, p
WHERE least(levenshtein(substr(name, greatest(1, e - 5), least(6, e)), pattern), levenshtein(substr(name, greatest(1, e - 6), least(7, e)), pattern), levenshtein(substr(name, greatest(1, e - 7), least(8, e)), pattern)) <= 1"""),
    "find_patterns": (find_patterns, "WITH e AS (SELECT p_partkey, lower(p_name) AS name, unnest(range(1, length(p_name) + 1)) AS e FROM part) SELECT p_partkey, e - 1 AS end_pos FROM e WHERE regexp_matches(left(name, e), '[a-m]+r?.{1,2}[gt]e*$')"),
    # ends are the As of every run of A that follows AC?[GT]{2,3}, however long the run is
    "find_patterns_dna": (find_patterns_dna, f"""WITH {DNA}, h AS (SELECT seq_id, p, substr(dna, p + 1, 6) AS g FROM (SELECT seq_id, dna, unnest(range(0, length(dna))) AS p FROM reference)),
f AS (SELECT DISTINCT seq_id, p + length(x) - 1 AS begin FROM (SELECT seq_id, p, unnest([regexp_extract(g, '^AC?[GT]{{2}}A'), regexp_extract(g, '^AC?[GT]{{3}}A')]) AS x FROM h) WHERE x <> ''),
a AS (SELECT seq_id, p, p - row_number() OVER (PARTITION BY seq_id ORDER BY p) AS island FROM h WHERE left(g, 1) = 'A'),
r AS (SELECT seq_id, min(p) AS begin, max(p) AS last FROM a GROUP BY seq_id, island)
SELECT seq_id, sum(last - begin + 1)::BIGINT AS n, max(last) AS last FROM f JOIN r USING (seq_id, begin) GROUP BY 1"""),
    "guess_formats": (guess_formats, "SELECT CASE left(text, 1) WHEN '>' THEN 'fasta' WHEN 'L' THEN 'genbank' WHEN 'I' THEN 'embl' ELSE 'raw' END AS format, count(*) AS n FROM documents GROUP BY 1"),
}
