"""Child tables, rotations, search in a written order, frequencies by dataset and planted repeats, each against its definition."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import children, kept, planted, repeats, suffixes


def dna(n, seed, letters="ACGT"):
    return "".join(random.Random(seed).choices(letters, k=n))


TEXTS = {1: dna(200, 1, "AC"), 2: "A" * 40, 3: "", 4: "ACGT", 5: dna(60, 5) * 2, 6: "ACGT"}


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame(list(TEXTS.items()), "seq_id long, dna string")


def children_of(lcp):
    """By the definitions, rank by rank."""
    n, out = len(lcp), {}
    for i in range(n):
        up = [q for q in range(i) if lcp[q] > lcp[i] and all(lcp[k] >= lcp[q] for k in range(q + 1, i))]
        down = [q for q in range(i + 1, n) if lcp[q] > lcp[i] and all(lcp[k] > lcp[q] for k in range(i + 1, q))]
        next_l = [q for q in range(i + 1, n) if lcp[q] == lcp[i] and all(lcp[k] > lcp[i] for k in range(i + 1, q))]
        out[i] = (min(up, default=None), max(down, default=None), min(next_l, default=None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_child_table(spark, seed):
    rng = random.Random(seed)
    tables = {1: [0] + [rng.randrange(4) for _ in range(300)], 2: [0], 3: [0, 5, 4, 3, 2, 1, 0], 4: [0, 1, 2, 3, 2, 1, 0, 2, 2], 5: [0] * 20, 6: [0, *range(60, 0, -1)]}
    df = spark.createDataFrame([(k, i, v) for k, t in tables.items() for i, v in enumerate(t)], "s long, rank long, lcp long").repartition(13)
    got = {(r.s, r["rank"]): (r.up, r.down, r.next_l) for r in children.child_table(df, "s").collect()}
    assert got == {(k, i): x for k, t in tables.items() for i, x in children_of(t).items()}
    assert children.child_table(df.limit(0), "s").count() == 0


def test_ranges_smaller_than_a_scope(spark, monkeypatch):
    rng = random.Random(7)
    table = [0] + [rng.randrange(6) for _ in range(400)]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(table)], "s string, rank long, lcp long")
    real = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *cols: real(self, 37, *cols))
    got = {r["rank"]: (r.up, r.down, r.next_l) for r in children.child_table(df, "s").collect()}
    assert got == children_of(table)


def test_rotations(ref):
    got = {(r.seq_id, r["rank"]): (r.pos, r.last) for r in suffixes.rotations(ref, "dna", "seq_id").collect()}
    want = {}
    for k, t in TEXTS.items():
        for rank, p in enumerate(sorted(range(len(t)), key=lambda p: (t[p:] + t[:p], p))):
            want[k, rank] = p, t[p - 1]
    assert got == want


@pytest.mark.parametrize("scope", [None, "seq_id"])
def test_search_in_the_written_order(spark, ref, tmp_path, monkeypatch, scope):
    monkeypatch.setattr(kept, "HEAD", 8)
    path = f"file://{tmp_path}"
    kept.build_order(ref, "dna", "seq_id", path, scope)
    patterns = ["A", "AC", "ACA", "G", "T", "AAAAAAAAAAAAAAAAAAAA", TEXTS[1][30:60], TEXTS[5][3:40], "ACGT", "ACGTA", "TTTTTTTTT", "", "Z", TEXTS[1]]
    got = {(r.pattern, r.seq_id): (r["first"], r["last"]) for r in kept.search_order(spark, path, spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string"), ref, "dna", "seq_id").collect()}
    places = sorted(((k, p) for k, t in TEXTS.items() for p in range(len(t))), key=lambda x: (TEXTS[x[0]][x[1] :], x))
    ranks, seen = {}, {}
    for i, (k, p) in enumerate(places):
        ranks[k, p] = i if scope is None else seen.setdefault(k, 0)
        seen[k] = seen.get(k, 0) + 1
    want = {}
    for pattern in patterns:
        for k, t in TEXTS.items():
            hit = [ranks[k, p] for p in range(len(t)) if t.startswith(pattern, p)]
            if hit:
                want[pattern, k] = min(hit), max(hit)
    assert got == want


def test_frequencies(spark):
    rng = random.Random(3)
    texts = [(i, dna(rng.randrange(0, 60), i, "AC"), rng.choice(["en", "fr", None])) for i in range(30)] + [(40, "ACACAC" * 5, "en"), (41, "ACACAC" * 5, "en")]
    df = spark.createDataFrame(texts, "seq_id long, dna string, lang string")
    hull, more = F.col("freq_0") >= 3, F.col("freq_1") <= 4
    got = {r.gram: (r.n, r.freq_0, r.freq_1) for r in repeats.frequencies(df, "dna", "seq_id", F.col("lang"), ("en", "fr"), hull, more, 3).collect()}
    want = {}
    for g in {t[a:b] for _, t, _ in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}:
        hits = [(i, lang, t[p + len(g) : p + len(g) + 1] or f"${i}") for i, t, lang in texts for p in range(len(t)) if t.startswith(g, p)]
        en, fr = ({i for i, x, _ in hits if x == lang} for lang in ("en", "fr"))
        if len(en) >= 3 and len(fr) <= 4 and len({r for *_, r in hits}) > 1:  # right-maximal
            want[g] = len(hits), len(en), len(fr)
    assert got == want and want


@pytest.mark.parametrize("period,most", [(1, 0), (1, 2), (3, 1)])
def test_planted_copies_stand_where_the_truth_says(spark, period, most):
    texts = {1: dna(1000, 1), 2: dna(99, 2), 3: "", 4: None, 5: dna(100, 5)}
    df = spark.createDataFrame(list(texts.items()), "seq_id long, dna string")
    truth = planted.copies(df, "dna", "seq_id", 5, 20, 100, period, most)
    rows = truth.collect()
    out = {r.seq_id: r.dna for r in planted.plant(df, "dna", "seq_id", truth, 100, period).collect()}
    assert len(rows) == 11 and len({r.slot for r in rows if r.seq_id == 1}) == 10
    motifs = {r.family: r.m for r in spark.range(5).select(F.col("id").alias("family"), planted.motif(F.col("id").cast("string"), 20, "plant-1").alias("m")).collect()}
    changed = {k: list(t) if t is not None else None for k, t in texts.items()}
    for r in rows:
        assert sum(x != y for x, y in zip(r.copy, motifs[r.family])) == r.n_mut <= most
        assert r.slot * 100 <= r.pos and r.pos + 19 * period + 1 <= r.slot * 100 + 100
        changed[r.seq_id][r.pos : r.pos + 19 * period + 1 : period] = r.copy
    assert out == {k: "".join(t) if t is not None else None for k, t in changed.items()}
