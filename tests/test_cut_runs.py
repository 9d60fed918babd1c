"""Runs up to a cutoff: those behind it are not numbered."""

from strandline.operators import streams


def test_runs_behind_the_cutoff_are_not_numbered(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 5) for i in range(1000)], "place long, n long")
    taken, real = [], streams.stored
    monkeypatch.setattr(streams, "stored", lambda d, label: (lambda t: (taken.append(t.count()), t)[1])(real(d, label)))
    for bases, runs in ((10**9, 7), (11, 400), (10**9, 2000)):
        want, before = [], 0
        for i in range(1000):
            if before < bases and i < runs:
                want.append((i, min(i % 5, bases - before)))
            before += i % 5
        taken.clear()
        assert sorted((r.place, r.n) for r in streams.cut_runs(df, "n", "place", bases, runs).collect()) == want
        assert max(taken) <= runs
