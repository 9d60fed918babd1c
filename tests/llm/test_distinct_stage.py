"""The pipeline's near-duplicate stage against brute force, around a similarity of 0.8 over five words."""

import random

import corpus_pipeline


def test_copies_just_above_the_threshold_go(spark):
    rng = random.Random(5)
    texts, kept = [], []
    for k in range(30):
        text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(text)
        for i in range(4 + k % 2):  # four scattered edits leave 0.815 of five-word shingles and 0.8498 of four-word ones; five leave 0.774
            copy[20 + 30 * i] = f"x{rng.randrange(10**6)}"
        texts += [text, copy]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    for i, a in enumerate(sets):
        if not any(100 * len(a & b) >= 80 * len(a | b) for b in sets[:i]):
            kept.append(i)
    assert 30 < len(kept) < 60
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()) == kept
