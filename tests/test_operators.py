"""Operators against brute force in Python on seeded random texts, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.operators import align, grams, repeats, search, streams, suffixes


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.fixture(scope="module")
def texts():
    return {i: t for i, t in enumerate([dna(700, 1), dna(90, 2), "", "A", "ACACACACAC", dna(300, 3) * 2, "AAAA"])}


@pytest.fixture(scope="module")
def ref(spark, texts):
    return spark.createDataFrame(list(texts.items()), "seq_id long, dna string").cache()


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_reverse_complement_twice_is_identity(ref, texts):
    got = ref.select("seq_id", seq.reverse_complement(seq.reverse_complement(F.col("dna"))).alias("s"), seq.reverse_complement(F.col("dna")).alias("r")).collect()
    assert all(r.s == texts[r.seq_id] and r.r == rc(texts[r.seq_id]) for r in got)


def test_scalar_nulls(spark):
    row = spark.createDataFrame([(None, "ACGT")], "a string, b string").select(seq.normalize(F.col("a")).alias("n"), seq.hamming(F.col("a"), F.col("b")).alias("h"), seq.packed_words(F.col("a")).alias("w")).first()
    assert row.n is None and row.w is None


def test_packed_words_and_hamming(spark):
    a, b = dna(31, 5), dna(31, 6)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(seq.packed_words(F.col("a"))[0].alias("x"), seq.packed_words(F.col("b"))[0].alias("y"), seq.hamming(F.col("a"), F.col("b")).alias("h")).withColumn("p", seq.packed_hamming(F.col("x"), F.col("y"))).first()
    value = 0
    for c in a:
        value = value * 4 + "ACTG".index(c)
    assert row.x == value and row.p == row.h == sum(x != y for x, y in zip(a, b))


@pytest.mark.parametrize("size", [1, 4, 256, 300])
def test_windows(ref, texts, size):
    got = {(r.seq_id, r.pos): r.gram for r in grams.windows(ref, "dna", size, "seq_id").collect()}
    assert got == {(i, p): t[p : p + size] for i, t in texts.items() for p in range(len(t) - size + 1)}


def test_similarity_is_symmetric_and_bounded(ref):
    rows = grams.similarity(ref, "dna", 6, "seq_id", 0.02)[0].collect()
    assert rows and all(r.a < r.b and 0 < r.sim <= 1 for r in rows)


def test_counts_add_up(ref, texts):
    rows = grams.directory(ref, "dna", 3, "seq_id").orderBy("gram").collect()
    assert sum(r.cnt for r in rows) == sum(max(0, len(t) - 2) for t in texts.values())
    assert all(b.first == a.first + a.cnt for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("period", [1, 2, 3])
def test_suffix_array_bwt_and_occurrences(ref, texts, period):
    order = suffixes.suffix_array(ref, "dna", "seq_id", period)
    table = suffixes.occurrences(suffixes.transform(ref, order, "dna", "seq_id", period), "seq_id").collect()
    first = suffixes.first_column(ref, "dna", "seq_id", period).collect()
    for i, t in texts.items():
        mine = sorted((r for r in table if r.seq_id == i), key=lambda r: r.rank)
        want = sorted(range(len(t)), key=lambda p: (t[p::period], p))
        assert [r.pos for r in mine] == want
        assert [r.bwt for r in mine] == [t[p - period] if p >= period else "$" for p in want]
        for letter in "ACGT":
            assert [r.first for r in first if (r.seq_id, r.letter) == (i, letter)] == ([sum(r.bwt in "ACGT" and r.bwt < letter for r in mine)] if t else [])
            assert not mine or mine[-1][f"occ_{letter.lower()}"] == sum(r.bwt == letter for r in mine)


def test_streams(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    assert sorted(r.ord for r in streams.counter(df, "v", "id").collect()) == list(range(200))
    by = {r.id: r.ord for r in streams.counter(df, "v", "id").collect()}
    assert sorted(by, key=by.get) == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    names = {(r.v, r.name_id) for r in streams.namer(df, "v").collect()}
    assert names == {(v, i) for i, v in enumerate(sorted({r[2] for r in rows}))}
    for g in "abc":
        values = [r[2] for r in rows if r[1] == g]
        tuples = [list(r.tuple) for r in streams.tupler(df.where(F.col("g") == g), "v", 3, ["g"], ["id"]).orderBy("id").collect()]
        assert tuples == [values[i : i + 3] for i in range(len(values) - 2)]
        echoes = [list(r.echo) for r in streams.echoer(df.where(F.col("g") == g), "v", 3, ["g"], ["id"]).orderBy("id").collect()]
        assert echoes == [values[i - 2 : i + 1][::-1] for i in range(2, len(values))]
    assert streams.counter(df.where("false"), "id").count() == 0


def test_environments(spark):
    def edits(s):
        out = {s} | {s[:i] + c + s[i + 1 :] for i in range(len(s)) for c in "ACGT"}
        return out | {s[:i] + s[i + 1 :] for i in range(len(s))} | {s[:i] + c + s[i:] for i in range(len(s) + 1) for c in "ACGT"}

    df = spark.createDataFrame([(1, "ACG"), (2, ""), (3, "AA")], "k long, s string")
    got = streams.edit_environment(df, "s", "ACGT", "k").collect()
    for k, s in ((1, "ACG"), (2, ""), (3, "AA")):
        assert {r.variant for r in got if r.k == k} == edits(s)
    assert streams.hamming_environment(df, "s", "ACGT", "k").where("k = 1").count() == 1 + 3 * 3


@pytest.mark.parametrize("period", [2, 3])
def test_alignment_equals_brute_force(spark, ref, texts, period):
    length = 8
    m = length * period
    rng = random.Random(9)
    reads = []
    for i in range(40):
        t = texts[rng.choice([0, 1, 5])]
        p = rng.randrange(len(t) - m + 1)
        r = list(t[p : p + m])
        for j in rng.sample(range(m), rng.randrange(period + 2)):
            r[j] = rng.choice("ACGT")
        reads.append((i, "".join(r) if i % 2 else rc("".join(r))))
    df = spark.createDataFrame(reads, "read_id long, seq string")
    found = align.align(df, ref, period, length)
    want = set()
    for i, s in reads:
        for strand, q in (("+", s), ("-", rc(s))):
            for k, t in texts.items():
                for p in range(len(t) - m + 1):
                    miss = sum(a != b for a, b in zip(q, t[p : p + m]))
                    if miss <= period - 1:
                        want.add((i, strand, k, p, miss))
    assert {(r.read_id, r.strand, r.seq_id, r.pos, r.mismatches) for r in found.collect()} == want
    assert align.first_hits(found).count() == len({w[0] for w in want})
    assert {r.read_id for r in align.rescued(found).collect()} == {w[0] for w in want if w[1] == "-"} - {w[0] for w in want if w[1] == "+"}


def test_exact_spaced_reports_misses(spark, ref, texts):
    pattern = texts[0][10:34:3]
    df = spark.createDataFrame([(1, pattern), (2, "T" * 8)], "pattern_id long, pattern string")
    rows = align.exact_spaced(df, ref, 3, 8).collect()
    assert (0, 10) in {(r.seq_id, r.pos) for r in rows if r.pattern_id == 1}
    assert [(r.seq_id, r.pos) for r in rows if r.pattern_id == 2] == [(-1, -1)]


def test_search(spark, ref, texts):
    got = {(r.seq_id, r.pos) for r in search.find_exact(ref, "dna", "ACAC", "seq_id").collect()}
    assert got == {(i, p) for i, t in texts.items() for p in range(len(t)) if t.startswith("ACAC", p)}
    patterns = spark.createDataFrame([(1, "ACAC"), (2, "GATTA"), (3, texts[0][-5:])], "pattern_id long, pattern string")
    multi = {(r.pattern_id, r.seq_id, r.pos) for r in search.find_multi(ref, "dna", patterns, "seq_id", 4).collect()}
    assert multi == {(k, i, p) for k, s in ((1, "ACAC"), (2, "GATTA"), (3, texts[0][-5:])) for i, t in texts.items() for p in range(len(t)) if t.startswith(s, p)}


def test_approximate_and_close_pairs(spark):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    texts = [dna(30, s) for s in range(6)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {(r.k, r.end_pos, r.distance) for r in search.find_approximate(df, "t", "ACGTA", 2, "k").collect()}
    want = set()
    for k, t in enumerate(texts):
        for e in range(len(t or "")):
            best = min(lev("ACGTA", t[b : e + 1]) for b in range(e + 2))
            if best <= 2:
                want.add((k, e, best))
    assert got == want
    rng = random.Random(4)
    words = ["".join(rng.choices("ab", k=8)) for _ in range(30)]
    pairs = spark.createDataFrame([(i, "x", w) for i, w in enumerate(words)], "id long, block string, w string")
    found = {(r.a, r.b, r.distance) for r in search.close_pairs(pairs, "w", "id", ["block"], 2, 6).collect()}
    assert found == {(i, j, lev(a, b)) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and lev(a, b) <= 2}


def test_scored_search(spark):
    def best(p, t):
        # global on the pattern, free start in the text
        row = [0] * (len(t) + 1)
        rows = [row]
        for i, x in enumerate(p):
            new = [(i + 1) * -2]
            for j, y in enumerate(t):
                new.append(max(rows[-1][j] + (1 if x == y else -1), rows[-1][j + 1] - 2, new[j] - 2))
            rows.append(new)
        return rows[-1]

    texts = [dna(40, s) for s in range(5)] + ["", None]
    got = {(r.k, r.end_pos, r.score) for r in search.find_scored(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "t", "ACGTA", 2, "k").collect()}
    assert got == {(k, e, s) for k, t in enumerate(texts) for e, s in enumerate(best("ACGTA", t or "")[1:]) if s >= 2}


def test_global_starts(spark):
    rows = [(i, (i * 7) % 5) for i in range(60)]
    got = {r.k: r.start for r in streams.global_starts(spark.createDataFrame(rows, "k long, n long"), "n", "k").collect()}
    assert got == {k: sum(n for j, n in rows if j < k) for k, _ in rows}


def test_repeats(ref, texts):
    got = {(r.seq_id, r.pos, r.len) for r in repeats.tandem(ref, "dna", 2, 4, "seq_id").collect()}
    want = set()
    for i, t in texts.items():
        p = 0
        while p < len(t) - 2:
            n = 0
            while p + n + 2 < len(t) and t[p + n] == t[p + n + 2]:
                n += 1
            if n and n + 2 >= 4:
                want.add((i, p, n + 2))
            p += n + 1
    assert got == want
    runs = {(r.seq_id, r.letter, r.run_len) for r in repeats.homopolymers(ref, "dna", "ACGT", 3, "seq_id").collect()}
    assert (6, "A", 4) in runs


def test_suffix_order_of_one_long_text(spark):
    base = dna(3000, 11)
    long_ = base + "ACGT" * 400 + base[:2500] + "A" * 700 + dna(12_000, 12)
    texts = {1: long_, 2: "A" * 90, 3: base[100:400]}
    df = spark.createDataFrame(list(texts.items()), "seq_id long, dna string")
    rows = suffixes.suffix_array(df, "dna", "seq_id").collect()
    for i, t in texts.items():
        mine = [r.pos for r in sorted((r for r in rows if r.seq_id == i), key=lambda r: r.rank)]
        assert mine == sorted(range(len(t)), key=lambda p: t[p:])
    every = [(r.seq_id, r.pos) for r in suffixes.collection_array(df, "dna", "seq_id").orderBy("rank").collect()]
    assert every == sorted(((i, p) for i, t in texts.items() for p in range(len(t))), key=lambda x: (texts[x[0]][x[1] :], x))


def brute_repeats(texts, least):
    """gram: n, n_seqs, and whether it is supermaximal."""
    from collections import defaultdict

    places = defaultdict(list)
    for i, t in texts.items():
        for b in range(len(t)):
            for e in range(b + least, len(t) + 1):
                places[t[b:e]].append((i, t[b - 1] if b else f"^{i}", t[e] if e < len(t) else f"${i}"))
    out = {}
    for g, found in places.items():
        n, seqs, left, right = len(found), *({x[k] for x in found} for k in range(3))
        if n >= 2 and len(left) >= 2 and len(right) >= 2:
            out[g] = (n, len(seqs), len(left) == n == len(right))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_every_length(spark, seed):
    rng = random.Random(seed)
    core = "".join(rng.choices("ACGT", k=60))
    texts = {i: "".join(rng.choices("AC", k=rng.randrange(0, 40))) + core[rng.randrange(20) : rng.randrange(20, 61)] + "".join(rng.choices("ACGT", k=30)) for i in range(12)}
    texts |= {20: texts[3], 21: "AAAAAAAAAA", 22: "", 23: "AC"}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    want = brute_repeats(texts, 4)
    assert {(r.gram, r.n, r.n_seqs) for r in repeats.maximal_repeats(df, "t", "k", 4).collect()} == {(g, n, s) for g, (n, s, _) in want.items()}
    assert {(r.gram, r.n) for r in repeats.supermaximal_repeats(df, "t", "k", 4).collect()} == {(g, n) for g, (n, _, top) in want.items() if top}


@pytest.mark.parametrize("pattern", ["A", "AC*G", "A+C?T", "[AC]{2,3}.T", "A.*T", "G{3}", "A?C?G?"])
def test_wildcards(spark, pattern):
    import re

    texts = [dna(40, s) for s in range(5)] + ["", None, "AAAA"]
    got = {(r.k, r.end_pos) for r in search.find_wildcards(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "t", pattern, "k").collect()}
    assert got == {(k, e) for k, t in enumerate(texts) for e in range(len(t or "")) if any(re.fullmatch(pattern, t[b : e + 1]) for b in range(e + 1))}


def test_pieces_equal_approximate_search(spark, ref):
    patterns = [dna(24, 1), dna(700, 1)[100:130], "ACACACACAT", dna(12, 77)]
    df = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    got = {(r.pattern_id, r.seq_id, r.end_pos, r.distance) for r in search.find_pieces(ref, "dna", df, 2, "seq_id").collect()}
    want = {(i, r.seq_id, r.end_pos, r.distance) for i, p in enumerate(patterns) for r in search.find_approximate(ref, "dna", p, 2, "seq_id").collect()}
    assert got == want and got


def test_similarity_equals_brute_force(spark):
    from collections import Counter

    texts = {i: dna(60, i // 3) + dna(30, 100 + i) for i in range(12)} | {50: dna(60, 0) + dna(30, 100), 51: "ACACACACACACAC", 52: "ACACAC", 53: "", 54: "AC"}
    pairs, groups = grams.similarity(spark.createDataFrame(list(texts.items()), "k long, t string"), "t", 5, "k", 0.4)
    counts = {i: Counter(t[p : p + 5] for p in range(len(t) - 4)) for i, t in texts.items() if len(t) > 4}
    heads = {i: min(j for j in counts if counts[j] == c) for i, c in counts.items()}
    assert {r.k: r["class"] for r in groups.collect()} == heads
    want = {}
    for a in set(heads.values()):
        for b in set(heads.values()):
            sim = sum((counts[a] & counts[b]).values()) / min(sum(counts[a].values()), sum(counts[b].values()))
            if a < b and sim >= 0.4:
                want[a, b] = pytest.approx(sim)
    assert {(r.a, r.b): r.sim for r in pairs.collect()} == want
