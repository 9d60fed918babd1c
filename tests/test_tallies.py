"""Windows counted where texts are read, against plain counts."""

from collections import Counter, defaultdict

from strandline.operators import grams, kept, repeats, tallies

TEXTS = [(1, "ACGTACGTNACGT"), (2, "ACGTACGTNACGT"), (3, "AC"), (4, ""), (5, None), (6, "\x00é\U0001f600é\x00é"), (7, "TTTTTTTTTTTT"), (8, "ACGTTACGTTACG")]


def test_tallies(spark):
    df = spark.createDataFrame(TEXTS, "k long, t string")
    shapes = [[0, 1, 2], [0, 2, 3]]
    want, texts = Counter(), defaultdict(set)
    for k, t in TEXTS:
        for s, shape in enumerate(shapes):
            for p in range(len(t or "") - shape[-1]):
                want[s, "".join(t[p + i] for i in shape)] += 1
                texts[s, "".join(t[p + i] for i in shape)].add(k)
    found = tallies.tallied(df, "t", shapes)
    # no window is a row of the plan
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.shape, r.gram): (r.n, r.n_texts) for r in found.collect()} == {x: (n, len(texts[x])) for x, n in want.items()}
    assert {(r["class"], r.k, r.total) for r in tallies.gram_classes(df, "t", 3, "k").collect()} == {tuple(r) for r in grams.classes(grams.gram_counts(df, "t", 3, "k"), "k").select("class", "k", "total").collect()}
    apart = Counter(sum(a != b for a, b in zip(t[p : p + 4], t[p + 4 : p + 8])) for _, t in TEXTS for p in range(len(t or "") - 7))
    assert {r.mismatches: r.n for r in tallies.shifted_distances(df, "t", 4).collect()} == apart
    assert tallies.tallied(df.limit(0), "t", shapes).count() == 0 == repeats.maximal(df.limit(0), "t", 3, "k").count()


def test_gram_index_has_a_row_a_gram_and_batch(spark, tmp_path):
    for kind in ("long", "string"):
        df = spark.createDataFrame([(k if kind == "long" else f"k{k}", t) for k, t in TEXTS], f"k {kind}, t string").repartition(3)
        kept.build_grams(df, "t", "k", f"file://{tmp_path}/{kind}", 4)
        index = kept.open_grams(spark, f"file://{tmp_path}/{kind}", 4)
        assert index.count() == index.select("gram", "batch").distinct().count() < sum(max(0, len(t or "") - 3) for _, t in TEXTS)
        wanted = ["A", "AC", "TTTT", "é", "GG", "\x00é"]
        patterns = spark.createDataFrame([(p,) for p in wanted], "pattern string")
        want = {(p, r.k): places for p in wanted for r in df.collect() if (places := [i for i in range(len(r.t or "") - 3) if r.t.startswith(p, i)])}
        rows = kept.ordered_places(kept.find_grams(index, patterns), "k").collect()
        assert {(r.pattern, r.k): r.places for r in rows} == want and len(rows) == len(want)
        assert kept.ordered_places(kept.find_grams(index, patterns.limit(0)), "k").count() == 0
    kept.build_grams(df.limit(0), "t", "k", f"file://{tmp_path}/none", 4)
