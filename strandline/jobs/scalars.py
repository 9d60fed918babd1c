"""Jobs over scalar sequence functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.operators.grams import windows
from strandline.operators.streams import counter, cut_runs
from strandline.operators.tallies import shifted_distances, tallied
from strandline.sources.formats import fasta_lines
from strandline.sources.tables import table

from .common import DNA, reference, windows_sql


def revcomp(spark, d):
    return reference(spark, d).select("seq_id", seq.reverse_complement(F.col("dna")).alias("rc"))


def revcomp_packed(spark, d):
    """Upper-cased texts with N kept, which counts as G here; and whether turning twice gives the text without N."""
    s = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.translate("text", "acgtn", "ACGTN"), "[^ACGTN]", "").alias("s"))
    rc = seq.reverse_complement(F.col("s"), n_pairs_with_c=True)
    return s.select("seq_id", rc.alias("rc"), seq.is_reverse_complement(rc, F.translate("s", "N", "G")).alias("is_rc"))


def normalize_modes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", *(F.length(seq.normalize(t, m)).cast("long").alias(m) for m in ("drop", "keep_upper", "n_to_a")))


def pack2bit(spark, d):
    return reference(spark, d).select("seq_id", F.posexplode(seq.packed_words(F.col("dna"))).alias("word_no", "word"))


def packed_hamming(spark, d):
    """Each word of 31 bases against the next, in packed form, the last one by its own length; the SQL compares characters."""
    words = reference(spark, d).select("seq_id", F.length("dna").alias("n"), seq.packed_words(F.col("dna")).alias("w")).where(F.size("w") > 1)
    pairs = words.select("seq_id", "n", F.posexplode(F.zip_with(F.slice(F.col("w"), F.lit(1), F.size("w") - 1), F.slice(F.col("w"), F.lit(2), F.size("w") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("word_no", "p"))
    size = F.least(F.lit(31), F.col("n") - 31 * (F.col("word_no") + 1))
    # a short last word stands for as many first bases of the word before
    first = F.call_function("shiftright", F.col("p.x"), (62 - 2 * size).cast("int"))
    return pairs.select("seq_id", "word_no", seq.packed_hamming(first, F.col("p.y"), seq.tail_mask(size)).alias("mismatches"))


def pack32(spark, d):
    """Full words of 64 bits, compared as the letters that they spell."""
    return reference(spark, d).select("seq_id", F.posexplode(seq.packed_words(F.col("dna"), 32)).alias("word_no", "word"))


def packed_revcomp(spark, d):
    """Reverse complements of packed words, on the packed form; the SQL turns letters round and packs them."""
    words = reference(spark, d).select("seq_id", F.length("dna").alias("n"), F.posexplode(seq.packed_words(F.col("dna"))).alias("word_no", "word"))
    return words.select("seq_id", "word_no", seq.packed_reverse_complement(F.col("word"), F.least(F.lit(31), F.col("n") - 31 * F.col("word_no"))).alias("word"))


def packed_shift(spark, d):
    """Packed texts of full words moved right by five bases."""
    full = reference(spark, d).select("seq_id", F.expr("left(dna, length(dna) - length(dna) % 31)").alias("dna")).where("dna <> ''")
    return full.select("seq_id", F.posexplode(seq.packed_shift(seq.packed_words(F.col("dna")), 5)).alias("word_no", "word"))


def hash_ranges(spark, d):
    """Numbers of each part's DNA cut to four letters: the range of 6-grams that start with it, and its number with length."""
    s = table(spark, d, "part").select("p_partkey", F.left(seq.normalize(F.col("p_name"), "keep_upper"), F.lit(4)).alias("s"))
    return s.select("p_partkey", seq.hash_range(F.col("s"), 6).alias("r"), seq.hash_with_length(F.col("s"), 6).alias("with_length")).select("p_partkey", "r.low", "r.high", "with_length")


def predefined_shapes(spark, d):
    """Counts of the documents' windows by hash of each predefined shape."""
    names, shapes = list(seq.SHAPES), [[i for i, c in enumerate(shape) if c == "1"] for shape in seq.SHAPES.values()]
    found = tallied(reference(spark, d), "dna", shapes)
    value = F.conv(F.translate("gram", seq.BASES, "0123"), 4, 10).cast("long")
    return found.select(F.element_at(F.array(*map(F.lit, names)), F.col("shape") + 1).alias("shape"), value.alias("hash"), "n")


def end_high_order(spark, d):
    """Neighbouring part names compared with the end above all letters."""
    names = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"))
    after = names.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    a, b = seq.end_high(F.col("a")), seq.end_high(F.col("b"))
    return names.join(after, "p_partkey").select("p_partkey", (a < b).alias("lower"), (a > b).alias("higher"), (F.col("a") < F.col("b")).alias("plain_lower"))


def string_edits(spark, d):
    """Insertion, replacement, erasure, infix, and fitting of part names."""
    n, three, two = F.col("p_name"), F.lit(3), F.lit(2)
    return table(spark, d, "part").select("p_partkey", seq.replaced(n, three, F.lit(0), F.lit("XY")).alias("inserted"), seq.replaced(n, three, two, F.lit("XYZ")).alias("swapped"), seq.replaced(n, three, two, F.lit("")).alias("erased"), F.substring(n, 3, 4).alias("infix"), seq.fitted(n, 12, ".").alias("fitted"), F.concat(n, F.lit("!")).alias("appended"))


def alphabet_codes(spark, d):
    """How often each code of four alphabets stands in part names."""
    letters = windows(table(spark, d, "part"), "p_name", 1, "p_partkey").select(F.col("gram").alias("c"))
    kinds = F.array(*(F.struct(F.lit(name).alias("alphabet"), seq.coded(F.col("c"), letters_, unknown).alias("code")) for name, letters_, unknown in (("dna", "ACGT", "A"), ("dna5", seq.DNA5, "N"), ("iupac", seq.IUPAC, "N"), ("amino", seq.AMINO, "X"))))
    return letters.select(F.inline(kinds)).groupBy("alphabet", "code").agg(F.count("*").alias("n"))


def letter_kinds(spark, d):
    """Whether part names' characters are DNA letters, Ns, or digits, and the number that a name's digits make."""
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", n.rlike("^[ACGT]*$").alias("is_dna"), n.rlike("^N+$").alias("is_n"), F.expr("try_cast(nullif(regexp_replace(p_name, '[^0-9]', ''), '') as bigint)").alias("number"))


def positional_hamming(spark, d):
    """Document i's first 64 bases against those of document i + 1, by ordinal."""
    rows = counter(reference(spark, d).select("seq_id", F.left("dna", F.lit(64)).alias("s")), "seq_id")
    after = rows.select((F.col("ord") - 1).alias("ord"), F.col("s").alias("t"))
    size = F.least(F.length("s"), F.length("t"))
    return rows.join(after, "ord").select("seq_id", F.when(size == 0, 0).otherwise(seq.hamming(F.expr("left(s, least(length(s), length(t)))"), F.expr("left(t, least(length(s), length(t)))"))).cast("long").alias("mismatches"))


def run_cutoffs(spark, d):
    """The runs of DNA letters of all documents, in order, as far as 20,000 bases and 3,000 runs reach; the last run is cut."""
    runs = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.posexplode(F.regexp_extract_all(F.translate("text", "acgtn", "ACGTN"), F.lit("[ACGT]+"), F.lit(0))).alias("run_no", "run"))
    sized = runs.select("seq_id", "run_no", F.length("run").cast("long").alias("n"), (F.col("seq_id") * 1_000_000 + F.col("run_no")).alias("place"))
    return cut_runs(sized, "n", "place", 20_000, 3_000).select("seq_id", "run_no", "n")


def cleaned_lines(spark, d):
    """Documents' DNA with Ns taken out, in lines of 70."""
    return fasta_lines(reference(spark, d).select(F.col("seq_id").alias("record_no"), F.col("seq_id").cast("string").alias("header"), F.col("dna").alias("seq"))).select("record_no", "line_no", "line")


def letter_classes(spark, d):
    """How many characters of each class a text has."""
    t = F.coalesce("text", F.lit(""))
    bases = F.length(F.regexp_replace(t, "[^ACGTacgt]", ""))
    others = F.length(F.regexp_replace(t, "[^RYMKSWBDHVNrymkswbdhvn-]", ""))
    return table(spark, d, "documents").select("doc_id", bases.cast("long").alias("n_bases"), others.cast("long").alias("n_ambiguous"), (F.length(t) - bases - others).cast("long").alias("n_other"))


def dna_runs(spark, d):
    """Runs of DNA letters with the gap before each."""
    runs = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.posexplode(F.regexp_extract_all(F.translate("text", "acgtn", "ACGTN"), F.lit("[^ACGT]*[ACGT]+"), F.lit(0))).alias("run_no", "piece"))
    run = F.length(F.regexp_extract("piece", "[ACGT]+$", 0))
    return runs.groupBy((F.length("piece") - run).cast("long").alias("gap_len"), run.cast("long").alias("run_len")).agg(F.count("*").alias("n"), F.sum(F.col("run_no").cast("long")).alias("sum_run_no"))


def count_dna(spark, d):
    """Bases of all texts, with N counted as A."""
    return table(spark, d, "documents").agg(F.sum(F.length(seq.normalize(F.col("text"), "n_to_a")).cast("long")).alias("n_bases"))


def shape_hashes(spark, d):
    """Counts by hash of the gapped shape 1101."""
    return windows(reference(spark, d), "dna", 4, "seq_id").groupBy(seq.shape_hash(F.col("gram"), "1101").alias("hash")).agg(F.count("*").alias("n"))


def spelled_hashes(spark, d):
    """The DNA that each 3-gram's number spells, with its count."""
    counts = windows(reference(spark, d), "dna", 3, "seq_id").groupBy(seq.shape_hash(F.col("gram"), "111").alias("hash")).agg(F.count("*").alias("n"))
    return counts.select("hash", seq.spell(F.col("hash"), 3).alias("gram"), "n")


def lcp_neighbours(spark, d):
    """Common prefix of each document's text and that of the next id."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(after, "doc_id").select("doc_id", seq.common_prefix(F.col("text"), F.col("next")).alias("lcp"))


def window_hamming(spark, d):
    """Histogram of the Hamming distance of a 24-base window and the one 24 further on, at every position."""
    return shifted_distances(reference(spark, d), "dna", 24)


def string_cases(spark, d):
    """Case functors and prefix tests on part names."""
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.upper(n).alias("up"), F.lower(n).alias("low"), F.reverse(n).alias("rev"), F.left(n, F.lit(4)).alias("pre"), F.right(n, F.lit(4)).alias("suf"), F.startswith(n, F.lit("p")).alias("has_p"))


JOBS = {
    "revcomp": (revcomp, f"WITH {DNA} SELECT seq_id, reverse(translate(dna, 'ACGT', 'TGCA')) AS rc FROM reference"),
    "revcomp_packed": (revcomp_packed, "WITH s AS (SELECT doc_id AS seq_id, regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', '', 'g') AS s FROM documents) SELECT seq_id, reverse(translate(s, 'ACGTN', 'TGCAC')) AS rc, reverse(translate(s, 'ACGTN', 'TGCAC')) = reverse(translate(translate(s, 'N', 'G'), 'ACGT', 'TGCA')) AS is_rc FROM s"),
    "normalize_modes": (normalize_modes, "SELECT doc_id, length(regexp_replace(text, '[^ACGT]', '', 'g')) AS \"drop\", length(regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGT]', '', 'g')) AS keep_upper, length(regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', '', 'g')) AS n_to_a FROM documents"),
    "pack2bit": (pack2bit, f"WITH {DNA}, w AS (SELECT seq_id, i AS word_no, substr(translate(dna, 'ACTG', '0123'), i * 31 + 1, 31) AS c FROM (SELECT seq_id, dna, unnest(range(0, (length(dna) + 30) // 31)) AS i FROM reference)) SELECT seq_id, word_no::INTEGER AS word_no, list_reduce(list_transform(string_split(c, ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b) AS word FROM w"),
    "packed_hamming": (packed_hamming, f"WITH {DNA}, w AS (SELECT seq_id, i, substr(dna, i * 31 + 1, 31) AS c, substr(dna, i * 31 + 32, 31) AS n FROM (SELECT seq_id, dna, unnest(range(0, (length(dna) + 30) // 31 - 1)) AS i FROM reference)) SELECT seq_id, i::INTEGER AS word_no, hamming(left(c, length(n)), n)::INTEGER AS mismatches FROM w"),
    "pack32": (pack32, f"WITH {DNA}, w AS (SELECT seq_id, i AS word_no, substr(translate(dna, 'ACTG', '0123'), i * 32 + 1, 32) AS c FROM (SELECT seq_id, dna, unnest(range(0, (length(dna) + 31) // 32)) AS i FROM reference)), v AS (SELECT seq_id, word_no, list_reduce(list_transform(string_split(c, ''), lambda x: x::HUGEINT), lambda a, b: a * 4 + b) AS u FROM w) SELECT seq_id, word_no::INTEGER AS word_no, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS word FROM v"),
    "packed_revcomp": (packed_revcomp, f"WITH {DNA}, w AS (SELECT seq_id, i AS word_no, translate(reverse(translate(substr(dna, i * 31 + 1, 31), 'ACGT', 'TGCA')), 'ACTG', '0123') AS c FROM (SELECT seq_id, dna, unnest(range(0, (length(dna) + 30) // 31)) AS i FROM reference)) SELECT seq_id, word_no::INTEGER AS word_no, list_reduce(list_transform(string_split(c, ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b) AS word FROM w"),
    "packed_shift": (packed_shift, f"WITH {DNA}, f AS (SELECT seq_id, 'AAAAA' || left(dna, (length(dna) // 31) * 31 - 5) AS dna FROM reference WHERE length(dna) >= 31), w AS (SELECT seq_id, i AS word_no, substr(translate(dna, 'ACTG', '0123'), i * 31 + 1, 31) AS c FROM (SELECT seq_id, dna, unnest(range(0, length(dna) // 31)) AS i FROM f)) SELECT seq_id, word_no::INTEGER AS word_no, list_reduce(list_transform(string_split(c, ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b) AS word FROM w"),
    "hash_ranges": (hash_ranges, "WITH s AS (SELECT p_partkey, translate(left(regexp_replace(translate(p_name, 'acgtn', 'ACGTN'), '[^ACGT]', '', 'g'), 4), 'ACGT', '0123') AS s FROM part), h AS (SELECT *, CASE WHEN s = '' THEN 0 ELSE list_reduce(list_transform(string_split(s, ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b) END AS h, (4 ^ (6 - length(s)))::BIGINT AS step FROM s) SELECT p_partkey, h * step AS low, (h + 1) * step AS high, ((4 ^ length(s))::BIGINT - 1) // 3 + h AS with_length FROM h"),
    "predefined_shapes": (predefined_shapes, f"WITH {DNA} " + " UNION ALL ".join(f"SELECT '{name}' AS shape, " + " + ".join(f"{4 ** (shape.count('1') - 1 - k)} * substr(c, {at + 1}, 1)::BIGINT" for k, at in enumerate([i for i, x in enumerate(shape) if x == '1'])) + f" AS hash, count(*) AS n FROM (SELECT translate(gram, 'ACGT', '0123') AS c FROM ({windows_sql(len(shape))})) GROUP BY 2" for name, shape in seq.SHAPES.items())),
    "end_high_order": (end_high_order, "SELECT a.p_partkey, a.p_name || '~' < b.p_name || '~' AS lower, a.p_name || '~' > b.p_name || '~' AS higher, a.p_name < b.p_name AS plain_lower FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"),
    "string_edits": (string_edits, "SELECT p_partkey, left(p_name, 3) || 'XY' || substr(p_name, 4) AS inserted, left(p_name, 3) || 'XYZ' || substr(p_name, 6) AS swapped, left(p_name, 3) || substr(p_name, 6) AS erased, substr(p_name, 3, 4) AS infix, rpad(left(p_name, 12), 12, '.') AS fitted, p_name || '!' AS appended FROM part"),
    "alphabet_codes": (alphabet_codes, "WITH c AS (SELECT upper(unnest(string_split(p_name, ''))) AS c FROM part), a AS (SELECT unnest([{'a': 'dna', 'l': 'ACGT', 'u': 0}, {'a': 'dna5', 'l': 'ACGTN', 'u': 4}, {'a': 'iupac', 'l': 'UTAWCYMHGKRDSBVN', 'u': 15}, {'a': 'amino', 'l': 'ARNDCQEGHILKMFPSTWYVBZX*', 'u': 22}]) AS x) SELECT x.a AS alphabet, (CASE WHEN instr(x.l, c) > 0 THEN instr(x.l, c) - 1 ELSE x.u END)::INTEGER AS code, count(*) AS n FROM c, a GROUP BY 1, 2"),
    "letter_kinds": (letter_kinds, "SELECT p_partkey, regexp_full_match(p_name, '[ACGT]*') AS is_dna, regexp_full_match(p_name, 'N+') AS is_n, try_cast(nullif(regexp_replace(p_name, '[^0-9]', '', 'g'), '') AS BIGINT) AS number FROM part"),
    "positional_hamming": (positional_hamming, f"WITH {DNA}, r AS (SELECT seq_id, left(dna, 64) AS s, lead(left(dna, 64)) OVER (ORDER BY seq_id) AS t FROM reference) SELECT seq_id, CASE WHEN least(length(s), length(t)) = 0 THEN 0 ELSE hamming(left(s, least(length(s), length(t))), left(t, least(length(s), length(t)))) END::BIGINT AS mismatches FROM r WHERE t IS NOT NULL"),
    "run_cutoffs": (run_cutoffs, "WITH p AS (SELECT doc_id, regexp_extract_all(translate(text, 'acgtn', 'ACGTN'), '[ACGT]+') AS l FROM documents), e AS (SELECT doc_id AS seq_id, unnest(range(len(l)))::INTEGER AS run_no, length(unnest(l)) AS n FROM p), s AS (SELECT *, sum(n) OVER (ORDER BY seq_id, run_no) - n AS before, row_number() OVER (ORDER BY seq_id, run_no) AS k FROM e) SELECT seq_id, run_no, least(n, 20000 - before)::BIGINT AS n FROM s WHERE before < 20000 AND k <= 3000"),
    "cleaned_lines": (cleaned_lines, f"WITH {DNA}, l AS (SELECT seq_id, [('>' || seq_id)] || list_transform(range(0, (length(dna) + 69) // 70), lambda i: substr(dna, i * 70 + 1, 70)) AS l FROM reference) SELECT seq_id AS record_no, unnest(range(len(l)))::INTEGER AS line_no, unnest(l) AS line FROM l"),
    "letter_classes": (letter_classes, "SELECT doc_id, length(regexp_replace(t, '[^ACGTacgt]', '', 'g')) AS n_bases, length(regexp_replace(t, '[^RYMKSWBDHVNrymkswbdhvn-]', '', 'g')) AS n_ambiguous, length(t) - length(regexp_replace(t, '[^ACGTacgt]', '', 'g')) - length(regexp_replace(t, '[^RYMKSWBDHVNrymkswbdhvn-]', '', 'g')) AS n_other FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"),
    "dna_runs": (dna_runs, "WITH p AS (SELECT doc_id, regexp_extract_all(translate(text, 'acgtn', 'ACGTN'), '[^ACGT]*[ACGT]+') AS l FROM documents), e AS (SELECT unnest(range(len(l))) AS run_no, unnest(l) AS piece FROM p) SELECT length(piece) - length(regexp_extract(piece, '[ACGT]+$')) AS gap_len, length(regexp_extract(piece, '[ACGT]+$')) AS run_len, count(*) AS n, sum(run_no)::BIGINT AS sum_run_no FROM e GROUP BY 1, 2"),
    "count_dna": (count_dna, "SELECT sum(length(regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', '', 'g')))::BIGINT AS n_bases FROM documents"),
    "shape_hashes": (shape_hashes, f"WITH {DNA}, w AS ({windows_sql(4)}), c AS (SELECT translate(gram, 'ACGT', '0123') AS c FROM w) SELECT substr(c, 1, 1)::BIGINT * 16 + substr(c, 2, 1)::BIGINT * 4 + substr(c, 4, 1)::BIGINT AS hash, count(*) AS n FROM c GROUP BY 1"),
    "spelled_hashes": (spelled_hashes, f"WITH {DNA}, w AS ({windows_sql(3)}), c AS (SELECT gram, translate(gram, 'ACGT', '0123') AS c FROM w) SELECT substr(c, 1, 1)::BIGINT * 16 + substr(c, 2, 1)::BIGINT * 4 + substr(c, 3, 1)::BIGINT AS hash, gram, count(*) AS n FROM c GROUP BY 1, 2"),
    "lcp_neighbours": (lcp_neighbours, "WITH p AS (SELECT a.doc_id, a.text AS s, b.text AS t FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, CASE WHEN length(s) = 0 OR length(t) = 0 THEN 0 ELSE coalesce(list_position(list_transform(list_zip(string_split(s, ''), string_split(t, '')), lambda x: x[1] IS NOT DISTINCT FROM x[2]), false) - 1, least(length(s), length(t))) END::BIGINT AS lcp FROM p WHERE s IS NOT NULL AND t IS NOT NULL"),
    "window_hamming": (window_hamming, f"WITH {DNA}, w AS (SELECT dna, unnest(range(0, length(dna) - 47)) AS p FROM reference) SELECT hamming(substr(dna, p + 1, 24), substr(dna, p + 25, 24))::BIGINT AS mismatches, count(*) AS n FROM w GROUP BY 1"),
    "string_cases": (string_cases, "SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, reverse(p_name) AS rev, left(p_name, 4) AS pre, right(p_name, 4) AS suf, starts_with(p_name, 'p') AS has_p FROM part"),
}
