"""The joined lexicon equals the sent one, and both equal counts by plain Python."""

import math
import random
from collections import Counter

import pytest

from strandline.llm import toxicity

MILD, BAD = "sea sun rock tree wind hill lamp door kill switch moronic lake".split(), "moron wretch grump kill".split()


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(MILD[:8] + MILD[11:], k=rng.randrange(5, 30))
        toxic = i % 5 == 0
        if toxic:
            words += rng.sample(BAD, 3) * 2
        elif i % 3 == 0:
            words += ["kill", "switch"]
        out.append((i, " ".join(words), int(toxic)))
    return [*out, (n, None, 0), (n + 1, "", 0), (n, "sun sun", 0)]


def learned(docs):
    """Entries and phrases by the definitions, one document after the other."""
    n = Counter(t for _, _, t in docs)
    counts = {0: Counter(), 1: Counter()}
    for _, text, toxic in docs:
        counts[toxic].update({e for w in set(toxicity.fold(text or "").split()) for e in toxicity.entries(w)})
    chosen = {}
    for e, bad in counts[1].items():
        good, share = counts[0][e], n[1] / (n[0] + n[1])
        weight = math.log((bad + 0.5) / (n[1] + 1)) - math.log((good + 0.5) / (n[0] + 1))
        evidence = 2 * (bad * math.log(bad / ((bad + good) * share)) + (good * math.log(good / ((bad + good) * (1 - share))) if good else 0))
        if bad >= toxicity.MIN_SUPPORT and weight >= toxicity.MIN_WEIGHT and evidence >= toxicity.MIN_EVIDENCE and bad > good:
            chosen[e] = (weight, bad)
    kept = {e: w for e, (w, bad) in chosen.items() if not any(len(o) > len(e) and o[: len(e)] == e and len(e) - 1 in toxicity.STEMS and chosen[o][1] >= 0.9 * bad for o in chosen)}
    pairs = {0: Counter(), 1: Counter()}
    for _, text, toxic in docs:
        words = toxicity.fold(text or "").split()
        pairs[toxic].update(set(zip(words, words[1:])))
    heaviest = lambda w: max((kept[e] for e in toxicity.entries(w) if e in kept), default=0.0)
    exceptions = {f" {v} {w} ": -max(heaviest(v), heaviest(w)) for (v, w), good in pairs[0].items() if good >= toxicity.EXCEPTION_SUPPORT and pairs[1][v, w] <= toxicity.EXCEPTION_SHARE * good and max(heaviest(v), heaviest(w)) > 0}
    return kept, exceptions


@pytest.fixture(scope="module")
def docs(spark):
    rows = texts(400, 3)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_entries_and_phrases_equal_plain_counts(docs):
    rows, df = docs
    kept, exceptions = learned(rows)
    lexicon = toxicity.learn(df.select("text", "toxic"))
    assert kept and lexicon.weights == pytest.approx(kept) and lexicon.exceptions == pytest.approx(exceptions)


def test_tables_equal_the_sent_lexicon(docs, monkeypatch):
    rows, df = docs
    sent = toxicity.learn(df.select("text", "toxic"))
    monkeypatch.setattr(toxicity, "MAX_LEXICON_BYTES", 0)
    joined = toxicity.learn(df.select("text", "toxic"))
    assert isinstance(joined, toxicity.Tables)
    assert {r.entry: r.weight for r in joined.weights.collect()} == pytest.approx(sent.weights)
    assert {r.entry: r.weight for r in joined.exceptions.collect()} == pytest.approx(sent.exceptions)
    assert (joined.slope, joined.shift) == pytest.approx((sent.slope, sent.shift))
    result = lambda lexicon: sorted((r.doc.doc_id, round(r.toxicity, 9)) for r in toxicity.score(df, lexicon).collect())
    assert result(joined) == result(sent) and len(result(joined)) == len(rows)


def test_empty_tables_by_join(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LEXICON_BYTES", 0)
    joined = toxicity.learn(docs[1].select("text", "toxic"))
    assert toxicity.score(docs[1].limit(0), joined).count() == 0
    assert toxicity.score(spark.createDataFrame([(1, None)], "doc_id long, text string"), joined).count() == 1
