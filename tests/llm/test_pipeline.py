"""Every stage of the corpus pipeline on a small table with clashing column names, nulls and repeated rows."""

import random

import pytest

import corpus_pipeline

CLASHING = ("toxicity", "mix_size", "mix_copies", "quality_kept", "kept", "loss", "doc", "copy", "component_id", "n_words", "tokens")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randrange(2, 7))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    texts[10:12] = [texts[9], texts[9]]  # copies
    texts += [None, "", "too short", "again and again " * 40, " ".join(w + "###" for w in rng.choices(words, k=60))]
    rows = [(i if i != 5 else None, t, "en" if i % 7 else None, f"s{i % 3}" if i % 5 else None, *[i] * len(CLASHING)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASHING)
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return spark.createDataFrame(rows, schema), f"file://{path}"


def test_stages(spark, corpus):
    docs, folder = corpus
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == r.kept for r in rows for c in CLASHING), name  # each row keeps its own values
        sizes.append(len(rows))
        kept = spark.createDataFrame(rows, docs.schema)
    assert sizes[0] == 60 and sizes[1] == 60 and sizes[2] == 58 and 1.3 * 58 < sizes[3] < 1.7 * 58
    last = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    assert len(last) == sizes[3] and all(r.n_tokens > 0 and len(r.decoded_sha256) == 64 for r in last)


def test_empty_table(spark, corpus):
    docs, folder = corpus
    none = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
