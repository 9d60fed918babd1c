"""Suffix order and common prefixes where many suffixes are equal for long, and tandem repeats of all periods."""

import random

import pytest

from strandline.operators import repeats, suffixes
from strandline.sources import tables


def dna(n, seed, letters="ACGT"):
    return "".join(random.Random(seed).choices(letters, k=n))


def order_of(texts):
    """(text's key, place) of all suffixes in order, ties by key and place."""
    return sorted(((k, p) for k, t in texts.items() for p in range(len(t))), key=lambda x: (texts[x[0]][x[1] :], x))


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


TEXTS = {1: "A" * 700, 2: dna(300, 1) * 3, 3: "", 4: "ACGT", 5: "ACGT", 6: dna(60, 2) + "A" * 150, 7: (dna(40, 3) + "C") * 12, 8: dna(300, 1)}


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame(list(TEXTS.items()), "seq_id long, dna string")


def test_collection_and_prefixes(spark, ref):
    levels = []
    order = suffixes.ordered(ref, "dna", "seq_id", None, levels=levels)
    want = order_of(TEXTS)
    got = sorted((r["rank"], r["id"], r["pos"]) for r in order.collect())
    assert [(k, p) for _, k, p in got] == want and [r for r, *_ in got] == list(range(len(want)))
    lcp = {r["rank"]: r["lcp"] for r in suffixes.common_prefixes(ref, order.withColumnRenamed("id", "seq_id"), "dna", "seq_id", "", levels).collect()}
    assert lcp == {i: shared(TEXTS[k][p:], TEXTS[want[i - 1][0]][want[i - 1][1] :]) if i else 0 for i, (k, p) in enumerate(want)}


def test_each_text_and_prefixes_without_levels(spark, ref):
    order = suffixes.suffix_array(ref, "dna", "seq_id")
    got = {(r.seq_id, r["rank"]): (r.pos, r.lcp) for r in suffixes.common_prefixes(ref, order, "dna", "seq_id").collect()}
    want = {}
    for k, t in TEXTS.items():
        places = [p for _, p in order_of({k: t})]
        for i, p in enumerate(places):
            want[k, i] = p, shared(t[p:], t[places[i - 1] :]) if i else 0
    assert got == want


def test_equal_keys_are_one_row(spark, monkeypatch):
    """One letter over and over, and one passage in many texts: what is dealt by ranges stays small, and rounds grow with the logarithm."""
    dealt, rounds = [], []
    real = tables.stored
    monkeypatch.setattr(suffixes, "stored", lambda df, label: (lambda t: (dealt.append(t.count()) if "before" in t.columns else None, rounds.append(label == "asked"), t)[-1])(real(df, label)))
    n = 20_000
    one = spark.createDataFrame([(1, "A" * n)], "seq_id long, dna string")
    rows = suffixes.suffix_array(one, "dna", "seq_id")
    assert rows.where(f"pos <> {n} - 1 - rank").count() == 0 and rows.count() == n
    assert sorted(dealt)[-2] < n / 4 and sum(rounds) <= 6  # the last round tells most of them apart
    dealt.clear()
    passage = dna(50, 9)
    many = spark.range(3000).selectExpr("id as seq_id", f"'{passage}' as dna")
    order = suffixes.collection_array(many, "dna", "seq_id")
    assert order.count() == 150_000 and max(dealt) <= 50
    first = [r.seq_id for r in order.where("pos = 0").orderBy("rank").collect()]
    assert first == list(range(3000))


def runs(text, most, least):
    out = set()
    for p in range(1, most + 1):
        i = 0
        while i + p < len(text):
            j = i
            while j + p < len(text) and text[j] == text[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least and not any(p % d == 0 and text[i : i + d] * (p // d) == text[i : i + p] for d in range(1, p)):
                out.add((p, i, j - i + p))
            i = j + 1
    return out


@pytest.mark.parametrize("chunk", [16, 64, 4096])
def test_tandem_all_against_plain_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "LONG_CHUNK", chunk)
    texts = {1: "A" * 200, 2: "ACG" * 50 + "ACGG" * 20, 3: dna(500, 4, "AC"), 4: "", 5: None, 6: dna(37, 5) + "ACACGT" * 3 * chunk + "T", 7: "AC", 8: "é日é日é日é日"}
    df = spark.createDataFrame(list(texts.items()), "seq_id long, dna string").repartition(3)
    got = sorted((r.seq_id, r.period, r.pos, r.len) for r in repeats.tandem_all(df, "dna", 7, 6, "seq_id").collect())
    assert got == sorted((k, *r) for k, t in texts.items() for r in runs(t or "", 7, 6))
    named = df.selectExpr("cast(seq_id as string) seq_id", "dna")
    assert {(r.seq_id, r.pos, r.len) for r in repeats.tandem(named, "dna", 2, 5, "seq_id").collect()} >= {("1", 0, 200)}
    assert repeats.tandem_all(df.limit(0), "dna", 7, 6, "seq_id").count() == 0


def test_most_places_are_those_of_the_best_maximal_repeat(spark, monkeypatch):
    # beside a window of its own: copies, texts' ends, overlaps and near copies
    texts = {1: dna(90, 1), 2: dna(90, 1), 3: dna(60, 1) + "A" * 12, 4: "A" * 9, 5: "ACAC" * 6, 6: dna(90, 1)[20:70], 7: "", 8: None, 9: "T" + dna(90, 1)[30:], 10: dna(400, 2, "AC")}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    found = repeats.maximal_repeats(df, "t", "k", 6).collect()
    every = {t[p : p + 6] for t in texts.values() for p in range(len(t or "") - 5)} | {"GGGGGG"}
    want = {g: max(ns) for g in every if (ns := [r.n for r in found if g in r.gram])}
    wanted = spark.createDataFrame([(g,) for g in every], "gram string")
    for sent in (0, 1 << 12):
        monkeypatch.setattr(repeats, "SENT", sent)
        assert {r.gram: r.n for r in repeats.most_places(df, "t", 6, wanted).collect()} == want and 0 < len(want) < len(every)


def test_runs_of_fewer_than_two_periods_leave_no_task(spark, monkeypatch):
    written = {}
    keep = repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, label: written.setdefault(label, keep(df, label)))
    monkeypatch.setattr(repeats, "TOGETHER", 3000)
    df = spark.createDataFrame([(k, dna(n, k)) for k, n in enumerate([2000, 1, 0, 1500, 12, 2500, 900])], "k long, t string")
    got = sorted(tuple(r) for r in repeats.tandem_all(df, "t", 12, 12, "k").collect())
    assert got == sorted((k, *r) for k, t in df.collect() for r in runs(t, 12, 12)) and got
    # of a period of 12, one equal letter would come to 12 letters
    assert written["runs"].count() < 3 * len(got) + 200
