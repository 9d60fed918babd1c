"""Similar texts found in blocks, against plain counts."""

import random
from collections import Counter

from strandline.operators import grams, overlaps


def test_similarity_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "LETTERS", 300)
    monkeypatch.setattr(overlaps, "FEWEST", 300)
    rng = random.Random(5)
    base = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(4)]
    texts = {i: base[i % 4][rng.randrange(40) :] + base[(i + i // 4) % 4][: rng.randrange(60)] for i in range(40)}
    texts |= {90: "", 91: None, 92: "ACG", 93: "A" * 50, 94: "A" * 20, 95: "é\U0001f600é日é" * 8, 96: "é\U0001f600é日é" * 3, 97: texts[3]}
    found, groups = grams.similarity(spark.createDataFrame(list(texts.items()), "k long, t string").repartition(5), "t", 6, "k", 0.5)
    # neither q-grams nor pairs that share some are rows of the plan
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan and "CartesianProduct" in plan
    counts = {i: Counter(t[p : p + 6] for p in range(len(t) - 5)) for i, t in texts.items() if len(t or "") > 5}
    heads = [i for i in counts if not any(j < i and counts[j] == counts[i] for j in counts)]
    want = {}
    for a in heads:
        for b in heads:
            common, of = (counts[a] & counts[b]).total(), min(counts[a].total(), counts[b].total())
            if a < b and 2 * common >= of:
                want[a, b] = common / of
    assert {(r.a, r.b): r.sim for r in found.collect()} == want and len(want) > 50
    named = spark.createDataFrame([(str(i), t) for i, t in texts.items()], "k string, t string")
    assert grams.similarity(named, "t", 6, "k", 0.5)[0].count() == len(want)
    assert grams.similarity(named.limit(0), "t", 6, "k", 0.5)[0].count() == 0
