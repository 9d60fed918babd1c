"""Edit environments of many tasks, against plain sets."""

from strandline.operators import streams


def test_variants_are_made_where_texts_were_dealt(spark, monkeypatch):
    monkeypatch.setattr(streams, "SPREAD", 2)
    rows = [(1, "AC"), (2, ""), (3, "AC"), (4, None), (5, "GGT"), (5, "GG"), (6, "A")]
    found = streams.edit_environment(spark.createDataFrame(rows, "k long, t string"), "t", "ACGT", "k")
    want = {(4, None)}
    for k, t in rows:
        if t is not None:
            want |= {(k, t)} | {(k, t[:i] + t[i + 1 :]) for i in range(len(t))} | {(k, t[:i] + c + t[j:]) for c in "ACGT" for i in range(len(t) + 1) for j in (i, i + 1) if j <= len(t)}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
