"""Ordered dataflow operators where one group has nearly all rows, cut into blocks smaller than the group."""

import pytest

from strandline.operators import streams

ROWS = [("hot", i, f"v{i}" if i % 7 else None) for i in range(200)] + [(None, 1, "n1"), (None, 2, "n2"), ("one", 5, "x")] + [(f"g{i}", k, f"{i}{k}") for i in range(6) for k in range(i)]


@pytest.fixture
def df(spark, monkeypatch):
    monkeypatch.setattr(streams, "BLOCK", 16)
    return spark.createDataFrame(ROWS, "g string, id long, v string").repartition(5)


def groups():
    out = {}
    for g, i, v in sorted(ROWS, key=lambda r: r[1]):
        out.setdefault(g, []).append((i, v))
    return out


@pytest.mark.parametrize("delta", [1, 2, 20, 0, -1, -3, -40])
def test_shifter(df, delta):
    got = {(r.g, r.id): r.shifted for r in streams.shifter(df, "v", delta, ["g"], ["id"], blank="-").collect()}
    want = {}
    for g, rows in groups().items():
        for k, (i, _) in enumerate(rows):
            want[g, i] = rows[k + delta][1] if 0 <= k + delta < len(rows) else "-"
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 40])
def test_echoes_and_tuples(df, k):
    echoes = {(r.g, r.id): list(r.echo) for r in streams.echoer(df, "v", k, ["g"], ["id"]).collect()}
    tuples = {(r.g, r.id): list(r.tuple) for r in streams.tupler(df, "v", k, ["g"], ["id"]).collect()}
    kept = {(r.g, r.id): list(r.tuple) for r in streams.tupler(df, "v", k, ["g"], ["id"], keep_last=True).collect()}
    for g, rows in groups().items():
        values = [v for _, v in rows]
        for p, (i, _) in enumerate(rows):
            assert echoes.get((g, i)) == (values[p - k + 1 : p + 1][::-1] if p >= k - 1 else None)
            assert tuples.get((g, i)) == (values[p : p + k] if p + k <= len(values) else None)
            assert kept[g, i] == (values[p : p + k] + [None] * k)[:k]


def test_places_and_samples(df):
    got = {(r.g, r.id): (r.from_start, r.from_end) for r in streams.placed(df, ["g"], ["id"]).collect()}
    assert got == {(g, i): (p, len(rows) - p) for g, rows in groups().items() for p, (i, _) in enumerate(rows)}
    taken = {(r.g, r.id) for r in streams.sampler(df, "v", 7, (1, 2, 4), ["g"], ["id"]).collect()}
    assert taken == {k for k, (_, left) in got.items() if left % 7 in (1, 2, 4)}


def test_no_task_holds_a_group(df):
    plan = streams.tupler(df, "v", 3, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(stream_block" in plan and "hashpartitioning(g" not in plan


def test_joiner_ends_with_the_shortest(spark):
    a, b, c = (spark.range(n).selectExpr("id as ord", f"id as x{n}") for n in (5, 3, 9))
    assert sorted(tuple(r) for r in streams.joiner(a, b, c).collect()) == [(i, i, i, i) for i in range(3)]


def test_empty(spark):
    none = spark.createDataFrame([], "g string, id long, v string")
    assert streams.tupler(none, "v", 3, ["g"], ["id"]).count() == streams.placed(none, ["g"], ["id"]).count() == 0
