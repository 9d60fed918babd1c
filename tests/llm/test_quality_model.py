"""The quality model against a plain one and on texts whose words are common."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import quality_rules
from strandline.llm.quality_rules import START

SCHEMA = "id long, lang string, text string"
KEPT = {"id": "id", "lang": "of"}


def plain_losses(texts, order):
    """Mean loss per text of a recursive model of one language."""
    windows, owners = Counter(), defaultdict(set)
    each = []
    for t in texts:
        s = quality_rules.sequence(t.encode().split())
        each.append([s[i - order + 1 : i + 1] for i in range(len(s)) if s[i] != START])
        windows.update(each[-1])
        for g in each[-1]:
            for k in range(order):
                owners[g[k:]].add(zlib.crc32(b" ".join(t.encode().split())) >> (32 - quality_rules.TAG_BITS))
    levels = {order: dict(windows)}
    for k in range(order - 1, 0, -1):
        lower = defaultdict(int)
        for g, n in levels[k + 1].items():
            lower[g[1:]] += n if g[1] == START else 1
        levels[k] = dict(lower)
    of_context = defaultdict(set)
    for g in levels:
        for w in levels[g]:
            of_context[w[:-1], g] |= owners[w]
    cuts, sums = {}, {}
    for k, level in levels.items():
        n = [sum(v == i for v in level.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        d = cuts[k] = [0, *(min(i, max(0.1 * i, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3))]
        sums[k] = defaultdict(lambda: [0, 0])
        for g, v in level.items():
            sums[k][g[:-1]][0] += v
            sums[k][g[:-1]][1] += d[min(3, v)]

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / (len(levels[1]) + 1)
        total, gamma = sums[len(g)][g[:-1]]
        v = levels[len(g)][g]
        if len(owners[g]) == 1:
            return below if len(of_context[g[:-1], len(g)]) == 1 else gamma / total * below
        return (v - cuts[len(g)][min(3, v)]) / total + gamma / total * below

    return [-sum(math.log(p(g)) for g in w) / max(1, sum(g[-1].isalpha() for g in w)) for w in each]


@pytest.mark.parametrize("model_rows", [10**6, 0])  # sent to the tasks; joined
def test_every_n_gram_counts_in_every_language(spark, monkeypatch, model_rows):
    monkeypatch.setattr(quality_rules, "BUNDLE", 300)
    monkeypatch.setattr(quality_rules, "PIECE", 200)
    monkeypatch.setattr(quality_rules, "HELD", 500)
    rng = random.Random(1)
    words = ["".join(rng.choices("aeiounrstü🙂", k=rng.randrange(1, 7))) for _ in range(150)]
    texts = {"en": [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(60)], "rare": ["unique words of a\x02 small \x03 language come from one text", ""], None: ["no language at all but ten words or more in it"]}
    rows = [(i, lang, t) for lang, part in texts.items() for i, t in enumerate(part)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.of, r.id): (r.base_failed, r.loss) for r in quality_rules.measure(docs, KEPT, model_rows).collect()}
    assert len(got) == len(rows)
    for lang, part in texts.items():
        fine = [i for i in range(len(part)) if not got[lang, i][0]]
        assert fine and all(got[lang, i] == (True, None) for i in range(len(part)) if i not in fine)
        for i, want in zip(fine, plain_losses([part[i] for i in fine], quality_rules.ORDER)):
            assert got[lang, i][1] == pytest.approx(want, rel=1e-6)


def test_no_n_gram_is_pruned(spark):
    # more distinct n-grams than any cap of before (500,000), most of which stand once; plus a small language
    docs = spark.range(0, 4000).select(F.col("id"), F.lit("en").alias("lang"), F.expr("array_join(transform(sequence(1, 60), i -> sha1(cast(id * 60 + i as string))), ' ')").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(-1, "rare", "zebra quagga and some more words of a small language")], SCHEMA))
    found = {r.lang: r["count"] for r in quality_rules.gram_losses(quality_rules.count_grams(docs)).groupBy("lang").count().collect()}
    assert found["en"] > 500_000 and found["rare"] > 5


def test_word_order_counts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("aeioulnrstdm", k=rng.randrange(3, 6))) for _ in range(100)]
    after = {w: rng.sample(words, 4) for w in words}
    texts = []
    for _ in range(150):
        text = [rng.choice(words)]
        while len(text) < 80:
            text.append(rng.choice(after[text[-1]]))
        texts.append(text)
    shuffled = [rng.sample(t, len(t)) for t in texts[:3]]
    rows = [(i, "en", " ".join(t)) for i, t in enumerate(texts + shuffled)]
    judged = {r.doc.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert sum(judged[i].kept for i in range(150)) == 150
    for i in range(3):
        assert judged[150 + i].loss > 1.2 * judged[i].loss and not judged[150 + i].base_failed and not judged[150 + i].kept
