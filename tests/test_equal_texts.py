"""Repeats and patterns where many texts are equal, against brute force; what a range of equal suffixes leaves open."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from strandline.operators import repeats, search


def brute(texts, least):
    """gram: n, texts, lefts, rights of every maximal repeat."""
    at = {}
    for k, t in texts.items():
        for a in range(len(t)):
            for b in range(a + least, len(t) + 1):
                at.setdefault(t[a:b], []).append((k, t[a - 1] if a else f"^{k}", t[b] if b < len(t) else f"${k}"))
    found = {g: (len(x), len({k for k, *_ in x}), len({l for _, l, _ in x}), len({r for *_, r in x})) for g, x in at.items()}
    return {g: v for g, v in found.items() if v[0] > 1 and v[2] > 1 and v[3] > 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_copies_count_as_texts(spark, seed):
    rng = random.Random(seed)
    kinds = ["".join(rng.choices("ab", k=rng.randrange(0, 9))) for _ in range(8)] + ["xyz", "wxyzw", "lonely", "twice"]
    rows = [(i, rng.choice("pq"), rng.choice(kinds)) for i in range(60)] + [(60, "p", "once only"), (61, "p", None), (62, "p", "twice"), (63, "p", "twice")]
    df = spark.createDataFrame(rows, "k long, s string, t string")
    got = {(r.scope, r.gram): (r.n, r.n_seqs) for r in repeats.maximal_repeats(df, "t", "k", 2, "s").collect()}
    want = {(s, g): v[:2] for s in "pq" for g, v in brute({k: t for k, x, t in rows if x == s and t}, 2).items()}
    assert got == want
    every = brute({k: t for k, _, t in rows if t}, 2)
    assert {r.gram: r.n for r in repeats.supermaximal_repeats(df, "t", "k", 2).collect()} == {g: n for g, (n, _, ls, rs) in every.items() if n == ls == rs}


def test_a_range_of_equal_suffixes_leaves_few_records(spark, monkeypatch):
    """All places of the range share as much as the ones before it."""
    n = 5000
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([7] * n), pa.array([f"^{i}" for i in range(n)])], names=["place", "length", "left"])
    monkeypatch.setattr(repeats, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 1)}))}))
    found = [r for b in repeats._scan_range(iter([rows])) for r in b.to_pylist()]
    assert len([r for r in found if r["kind"] != repeats.ROW]) <= 4


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_between_ranges_change_no_interval(monkeypatch, seed):
    """What a range leaves open is closed alike wherever ranges are cut."""
    rng, part = random.Random(seed), [0]
    monkeypatch.setattr(repeats, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: part[0])}))}))
    for _ in range(1500):
        n, most = rng.randint(2, 14), rng.randint(1, 4)
        rows = [(i, rng.randint(0, most) if i else 0, rng.choice("ab")) for i in range(n)]
        cuts, found = [0, *sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 3)))), n], []
        for part[0], (a, b) in enumerate(zip(cuts, cuts[1:])):
            batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a:b])], names=["place", "length", "left"])
            found += [SimpleNamespace(**r) for x in repeats._scan_range(iter([batch])) for r in x.to_pylist()]
        got = [(r.length, r.first, r.last, r.differ, r.leaves) for r in found if r.kind == repeats.ROW and r.length > 0]
        got += repeats._closed(sorted((r for r in found if r.kind != repeats.ROW), key=lambda r: (r.part, r.kind, r.seq)))
        want = set()
        for i, length, _ in rows[1:]:
            if length:
                a = max(k for k in range(i) if rows[k + 1][1] >= length and (k == 0 or rows[k][1] < length) and all(x[1] >= length for x in rows[k + 1 : i + 1]))
                b = max(k for k in range(i, n) if all(x[1] >= length for x in rows[i : k + 1]))
                inside = rows[a : b + 1]
                want.add((length, a, b, len({x[2] for x in inside}) > 1, all(x[1] == length for x in inside[1:])))
        assert sorted(got) == sorted(want)


def test_patterns_in_equal_texts(spark):
    texts = [(1, "red bolt"), (2, "red bolt"), (3, "a red bilt"), (4, None), (5, "red bolt")]
    df = spark.createDataFrame(texts, "k long, t string")
    patterns = spark.createDataFrame([("p", "red bol")], "pattern_id string, pattern string")
    got = {(r.k, r.end_pos, r.distance) for r in search.find_pieces(df, "t", patterns, 1, "k").collect()}
    assert got == {(k, e, d) for k in (1, 2, 5) for e, d in ((5, 1), (6, 0), (7, 1))} | {(3, 8, 1)}


def test_close_pairs_of_equal_texts(spark):
    """Equal texts of a block are compared once, and nothing is broadcast."""
    rng = random.Random(4)
    kinds = ["red bolt", "red bolts", "rad bolt", "blue ring", "blue rings", "green nut", "nut"]
    rows = [(i, rng.choice("xy"), rng.choice(kinds)) for i in range(80)] + [(80, None, "red bolt"), (81, None, "red bolt"), (82, "x", None)]
    found = search.close_pairs(spark.createDataFrame(rows, "k long, g string, t string"), "t", "k", ["g"], 2, 6)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, last = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
        return row[-1]

    some = [r for r in rows if r[1] and r[2] and len(r[2]) >= 6]
    want = {(a[0], b[0], edits(a[2], b[2])) for a in some for b in some if a[0] < b[0] and a[1] == b[1] and edits(a[2], b[2]) <= 2}
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "levenshtein" not in plan
