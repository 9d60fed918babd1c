"""The operators against brute force, plain libraries and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from strandline.llm import byte_bpe, graph, jaccard_join, licenses, mixing, quality_rules, top_inner, toxicity, url_rules, weak_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "a b c", "Ünï 🙂 e\u0301 \x00 \x1c x", "w " * 3000, "same text here for all of us to see", "same text here for all of us to see"]


def frame(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string, n_words int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, tokens string, n_words int")


# byte-level BPE
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_byte_bpe_equals_library(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 500)
    texts = [*ODD, "It's 'quoted'  with   spaces\r\n\r\nand 12345 números über", "日本語 text"]
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(PATH), special_tokens={})
    rows = byte_bpe.digests(frame(spark, texts), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = np.array(lib.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    coded = byte_bpe.encode(frame(spark, texts), PATH, public_tokenizers.PATTERN)
    assert {(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(coded, PATH).collect()} == {(i, (t or "").encode()) for i, t in enumerate(texts)}
    assert byte_bpe.digests(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


# toxicity
def test_folding():
    assert toxicity.fold("M0R0N, mоrоn！ mo\u200bron @pe") == "moron moron moron ape"


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(1)
    clean = ["".join(rng.choices("aeioulnrst", k=rng.randrange(3, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = rng.choices(clean, k=60)
        if bad:
            words[rng.randrange(60)] = "grumphish" if i % 12 else "Grumph1sh!"
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (7, None), (3, 0)], "doc_id long, toxic int")
    got = {r.doc.doc_id: r.toxicity for r in toxicity.train_and_score(df, lab).collect()}
    assert len(got) == 600 and all((got[i] >= toxicity.THRESHOLD) == bool(t) for i, t in labels)


def test_toxicity_edges(spark):
    df = frame(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    df = df.withColumn("toxicity", toxicity.F.lit("clash")).withColumn("doc", toxicity.F.lit(1))
    rows = toxicity.train_and_score(df, labels, tuple(df.columns)).collect()
    assert {(r.doc.tokens, r.doc.toxicity, r.doc.doc) for r in rows} == {("clash", "clash", 1)}
    assert len(rows) == len(ODD) and len({r.toxicity for r in rows}) == 1 and all(0 <= r.toxicity < toxicity.THRESHOLD for r in rows)
    assert toxicity.train_and_score(empty(spark), labels).count() == 0


def test_scores_equal_a_plain_match():
    """Every entry looked for one by one, in place of the automaton."""
    rng = random.Random(3)
    weights = {e: rng.uniform(1, 5) for w in ("grump", "moron", "mo", "wretch") for e in toxicity.entries(w)}
    phrases = {" no moron ": -2.0, " moron here ": -1.5}
    lexicon = toxicity.Lexicon(weights, phrases)
    for _ in range(200):
        words = rng.choices(["grump", "grumpy", "moron", "morons", "mo", "no", "here", "wretched", "fine", "x"], k=rng.randrange(0, 12))
        text = f" {' '.join(words)} "
        best, total = {}, 0.0
        for e, w in (weights | phrases).items():
            for at in range(len(text)):
                if text.startswith(e, at):
                    if w < 0:
                        total += w
                    else:
                        best[at] = max(best.get(at, 0.0), w)
        want = max(0.0, total + sum(best.values())) / (1 + math.log1p(max(1, len(words))) / 10)
        assert lexicon.raw(text[1:-1]) == pytest.approx(want)
        padded = rng.choice(["", "y " * 50_000])
        assert lexicon.raw((padded + text).strip()) >= 0


def test_exception_phrases_cancel():
    lexicon = toxicity.Lexicon({" kill ": 5.0}, {" kill switch ": -5.0})
    assert lexicon.raw("press kill switch now") == 0 and lexicon.raw("they kill now") > 0


# URL rules
def test_explicit_rules(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/1", "https://a.example.org/en/12?x=/es/", "http://example.org", "http://notexample.org/es/", "ftp://x.com/de/", "http://x.com/fr/", "http://x.net/#a", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "label_id long, bad boolean")
    from pyspark.sql import functions as F

    got = {r.page_id: r for r in url_rules.filter_urls(df, none, F.lit(None).cast("long")).collect()}
    want = {0: ("", "", None), 2: ("", "", None), 3: ("example.org", "/es/1", "example.org/es/"), 4: ("a.example.org", "/en/12", "example.org/en/1"), 5: ("example.org", "", None), 6: ("notexample.org", "/es/", "org/"), 7: ("x.com", "/de/", "com/de/"), 8: ("x.com", "/fr/", "com/fr/"), 9: ("x.net", "/", None), 10: ("b:", "//c/d", None)}
    assert all((got[i].host, got[i].path, got[i].rule) == w for i, w in want.items())
    assert got[3].verdict == got[4].verdict == got[7].verdict == "block" and got[0].verdict == got[6].verdict == "allow"


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        items = [t for t in "abcdef" if rng.random() < 0.4] or ["a"]
        bad = ("a" in items and "b" in items) if rng.random() < 0.9 else rng.random() < 0.3
        rows.append((items, bad))
    got = {tuple(r.tokens): (round(r.confidence, 9), r.support) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6, 6.0).collect()}
    import itertools

    rules, share = {}, sum(b for _, b in rows) / len(rows)

    def evidence(n, k):
        return 2 * (k * math.log(k / (n * share)) + ((n - k) * math.log((n - k) / (n * (1 - share))) if n > k else 0)) if k > n * share else 0

    for n in range(1, 7):
        for s in itertools.combinations("abcdef", n):
            hit = [b for items, b in rows if set(s) <= set(items)]
            if len(hit) >= max(0.02 * len(rows), url_rules.MIN_COUNT) and sum(hit) >= 0.6 * len(hit) and evidence(len(hit), sum(hit)) >= 6:
                rules[s] = (round(sum(hit) / len(hit), 9), len(hit))
    pruned = {s: v for s, v in rules.items() if not any(t in rules and rules[t][0] >= v[0] for n in range(1, len(s)) for t in itertools.combinations(s, n))}
    assert got == pruned and got
    # the inverted index against plain subsets
    rules = spark.createDataFrame([(i, list(t), len(t), c, n) for i, (t, (c, n)) in enumerate(got.items())], "rule_id long, tokens array<string>, size int, confidence double, support long")
    pages = [(i % 300 if i % 7 else None, f"u{i}" if i % 11 else None, items) for i, (items, _) in enumerate(rows)]
    parts = spark.createDataFrame([*pages, (5, "none", [])], "page_id long, url string, tokens array<string>")
    judged = {(r.page_id, r.url, tuple(r.tokens)): r.mined_confidence for r in url_rules.apply_rules(parts, rules).collect()}
    for page, url, items in [*pages, (5, "none", [])]:
        if url is not None:  # null urls have no tokens
            assert judged[page, url, tuple(items)] == max((c for t, (c, _) in got.items() if set(t) <= set(items)), default=None)
    assert url_rules.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "label_id long, bad boolean"), url_rules.F.lit(None).cast("long")).count() == 0


def test_rules_learned_on_one_half_hold_on_the_other(spark):
    """Held-out lift where hosts do point to bad pages; no rule where labels are drawn at random."""
    rng = random.Random(11)
    hosts = ["casino-win", "a", "b", "c", "d"]
    urls = [f"https://{rng.choice(['www', 'm'])}.{rng.choice(hosts)}.example.com/{rng.choice(['en', 'fr'])}/{i}" for i in range(1200)]
    bad = [rng.random() < (0.8 if "casino" in u else 0.1) for u in urls]
    number = url_rules.F.expr("cast(regexp_extract(path, '([0-9]+)$', 1) as bigint)")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad) if i % 2], "label_id long, bad boolean")
    blocked = {r.page_id for r in url_rules.filter_urls(pages, labels, number).collect() if r.mined}
    held = [bad[i] for i in blocked if i % 2 == 0]
    assert sum(held) > 0.7 * len(held) > 0.7 * 80
    random_labels = spark.createDataFrame([(i, rng.random() < 0.25) for i in range(1200)], "label_id long, bad boolean")
    assert not [r for r in url_rules.filter_urls(pages, random_labels, number).collect() if r.mined]


# quality rules
def test_base_counts():
    text = "a b c d e f a b c d e\n#x|\n#x|\n\n \n"
    words = text.encode().split()
    assert quality_rules.base_counts(text.encode(), len(text), words) == (13, 17, 4, 1, 10)
    rng = random.Random(2)
    for _ in range(50):
        w = [rng.choice("ab").encode() for _ in range(rng.randrange(0, 25))]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert quality_rules.repeated_words(w) == len(cover)


def test_quality_edges(spark):
    df = frame(spark, ODD).withColumns({c: quality_rules.F.lit(9) for c in ("kept", "loss", "doc", "quality_kept", "base_failed")})
    rows = quality_rules.judge(df, tuple(df.columns)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.n_words == len(WORD.findall(ODD[r.doc.doc_id] or "")) and not (r.base_failed and r.kept) and (r.doc.n_words, r.doc.kept, r.doc.doc) == (7, 9, 9)
    assert quality_rules.judge(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (1, None, "x y " * 9), (1, "", "x y " * 9)], "doc_id long, lang string, text string")
    assert sorted(r.base_failed for r in quality_rules.judge(nulls).collect()) == [True, True, True]


def test_perplexity_bands_are_the_quartiles_widened(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randrange(2, 7))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(80)] + [" ".join("".join(rng.choices("#%XQZJ&$", k=6)) for _ in range(120))]
    texts += [" ".join(w + rng.choice(["###", "***", "$$$"]) for w in rng.choices(words, k=120)), " ".join(words[:5] * 40)]
    rows = {r.doc.doc_id: r for r in quality_rules.judge(frame(spark, texts)).collect()}
    losses = sorted(r.loss for r in rows.values() if not r.base_failed)
    low, high = (losses[math.ceil(q * len(losses)) - 1] for q in (0.25, 0.75))
    for r in rows.values():
        wide = math.sqrt(1 + quality_rules.SHORT / r.n_words)
        inside = r.loss is not None and low - quality_rules.BELOW * (high - low) * wide <= r.loss <= high + quality_rules.ABOVE * (high - low) * wide
        assert r.kept == (not r.base_failed and inside)
    assert not rows[80].kept and not rows[81].kept and rows[82].base_failed and rows[82].loss is None and sum(r.kept for r in rows.values()) == 80


# mixing
def test_mixing_targets_and_copies(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)] + [(900, None, "z"), (5, "twice " * 4, "a"), (5, "twice " * 4, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: mixing.F.lit(1) for c in ("size", "target", "part", "doc", "copy", "mix_size", "mix_target", "mix_copies", "mix_row")})
    got = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            want |= {s: level * weights[s] for s in free}
            break
        want |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    taken = defaultdict(int)
    for r in got:
        assert r.mix_target == pytest.approx(want[r.source]) and 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_copies * r.mix_size
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 60 for s in order)
    again = mixing.mix(df).collect()
    assert sorted((r.doc.doc_id, r.mix_copies) for r in got) == sorted((r.doc.doc_id, r.mix_copies) for r in again)
    out = mixing.emitted(mixing.mix(df))
    assert out.columns == df.columns and out.count() == sum(r.mix_copies for r in got) and out.first().mix_size == 1
    assert mixing.mix(empty(spark)).count() == 0


# weak labels
def test_estimation_recovers_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    m = len(weak_labels.LABELLERS)
    votes = np.where(rng.random((20000, m)) < 0.85, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20000, m)) < 0.5] = weak_labels.NONE
    patterns, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, share, _ = weak_labels.estimate(patterns, n.astype(float), weight=0.01)
    assert ((posterior[inverse.ravel()] > 0.5) == truth).mean() > 0.93 and 0.6 < share < 0.95


def test_weak_labels_edges(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randrange(3, 8))) + rng.choice(["", "", "", ",", "."]) for _ in range(500)]
    good = [" ".join(rng.choices(words, k=60)) + ". " for _ in range(40)]
    bad = ["#$% " * 60 for _ in range(10)]
    rows = {r.doc_id: r for r in weak_labels.classify(frame(spark, [*good, *bad, *ODD])).collect()}
    assert len(rows) == 50 + len(ODD) and all(rows[i].kept for i in range(40)) and not any(rows[i].kept for i in range(40, 50))
    assert weak_labels.classify(empty(spark)).count() == 0


# Jaccard join
def clusters(texts, size, percent):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(up))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


def near_copies(seed, n=70):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=30)
    texts = []
    for base in range(6):
        text = rng.choices(words, k=rng.choice([8, 40, 120])) + passage * (base % 2)
        for _ in range(n // 6):
            copy = list(text)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts + [*ODD, "a", "A", "a b", "A b"]


@pytest.mark.parametrize(("frequent", "small", "pivots"), [(3, 16, (1, 4)), (2, 1, (1,)), (1, 1, ()), (1000, 2, (1,))])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, frequent, small, pivots):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "HUB_TEXTS", 5)
    monkeypatch.setattr(jaccard_join.links, "__defaults__", (4, 85, pivots))
    texts = near_copies(frequent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, texts)).collect()}
    assert got == dict(enumerate(clusters(texts, 4, 85)))


def test_a_long_text_is_hashed_in_linear_memory():
    import tracemalloc

    text = b"some words of a very long text " * 600_000  # 19 MB
    tracemalloc.start()
    key, start = jaccard_join.word_hashes(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(key) == 7 * 600_000 and len(np.unique(key)) == 7 and start[7] == 31 and peak < 30 * len(text)
    short, at = jaccard_join.word_hashes(text[:310])
    assert (short == key[:70]).all() and (at == start[:70]).all()


def test_entries_are_complete():
    rng = np.random.default_rng(3)
    for n in (2, 3, 7, 40, 200, 1500):
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut = rng.integers(0, int(0.08 * n) + 1)
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[cut:]], rng.integers(0, 2**63, cut).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            if 100 * common < 85 * (len(x) + len(y) - common):
                continue
            often = np.sort(rng.permutation(x)[: rng.integers(0, len(x) + 1)])
            (a, b), (c, d) = jaccard_join.entries(x, often), jaccard_join.entries(y, often)
            assert len(np.intersect1d(a, c)) or len(np.intersect1d(b, d))


def test_one_of_each(spark):
    texts = near_copies(9)
    df = frame(spark, texts).unionByName(frame(spark, ["x y z and more of it"])).unionByName(spark.createDataFrame([(None, "no id", "en", "s", "t", 1)], frame(spark, ["x"]).schema))
    kept = [r.doc_id for r in jaccard_join.one_of_each(df).collect()]
    assert kept.count(0) == 1 and kept.count(None) == 1
    assert {k for k in kept if k} <= {r for _, r in clusters(texts, 4, 85)} | {0}
    assert jaccard_join.one_of_each(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(100, 3), (3, 50), (7, 7), (60, 100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 41)}, 3: 3, 50: 3, 100: 3, 60: 3, 7: 7}


# licenses
def test_license_scan(spark):
    texts = ["Under the MIT License. MIT  LICENSE!", "Relesed under the MTI Licence", "apache-license", "nothing at all", None, "", "Licensed under the Apache Licence, Version 2.0", "mit\u00a0license", "permission is hereby granted, free of charge to any persn obtaining a copi"]
    rows = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels, rows[0].n_words) == (2, 2, 4, "mit", 6)
    assert rows[1].n_base == 0 and rows[1].labels == "mit" and 0 < rows[1].score < 1
    assert rows[2].base_labels == "apache" and rows[6].labels == "apache" and rows[8].labels == "mit"
    assert all(rows[i].labels == "" and rows[i].score == 0 and rows[i].first_word is None for i in (3, 4, 5, 7))


def test_fuzzy_matches_equal_a_full_scan():
    import regex

    rng = random.Random(7)
    notices = (("mozilla public license version 2 0", "mpl", 3), ("all rights reserved", "p", 1))
    patterns = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={e}}}") for n, _, e in notices]
    for _ in range(100):
        text = "".join(rng.choices("abc ", k=30))
        k = rng.randrange(2)
        notice = list(notices[k][0])
        for _ in range(rng.randrange(5)):
            notice[rng.randrange(len(notice))] = rng.choice("xyz")
        text += "".join(notice) + " tail"
        found = licenses.find_notices(text, notices)
        assert {i for i, *_ in found} == {i for i, p in enumerate(patterns) if p.search(text)}
        for i, a, b, errors in found:  # spans and edits: the piece alone matches with these errors, and no fewer
            assert regex.fullmatch(f"(?:{regex.escape(notices[i][0])}){{e<={errors}}}", text[a:b])
            assert not errors or not regex.fullmatch(f"(?:{regex.escape(notices[i][0])}){{e<={errors - 1}}}", text[a:b])
        for i in range(len(notices)):  # hits of one notice don't overlap
            spans = sorted((a, b) for j, a, b, _ in found if j == i)
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


# top-k
def test_top_inner_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.normal(size=8) * rng.choice([0.5, 3])).tolist()) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(300, 340)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (450, [0.5] * 3)]
    rows = top_inner.search_table(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()
    m = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v):
            m[i] = np.pad(np.floor(256 * np.array(v, np.float32).astype(float)), (0, 8 - len(v)))
    want = set()
    for q in (i for i in m if i % 50 == 0):
        scored = sorted((-int(m[q] @ m[c]), c) for c in m if c != q)[:5]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in rows} == want
    assert top_inner.search_table(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("sent", [0, 32 << 20])  # query blocks shuffled; broadcast
def test_top_inner_in_blocks_with_huge_vectors(spark, monkeypatch, sent):
    monkeypatch.setattr(top_inner, "QUERY_BLOCK", 3)
    monkeypatch.setattr(top_inner, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(top_inner, "SEED_ROWS", 8)
    monkeypatch.setattr(top_inner, "MAX_SENT", sent)
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.normal(size=20) * rng.choice([0.1, 1, 4])).tolist()) for i in range(600)]
    huge = [(50, [1e8] + [0.0] * 19), (7, [1e30] * 20), (8, [8e6] * 20), (9, [-3e38] * 20)]  # scaled lengths from 2 ** 31 on take no part
    df = spark.createDataFrame([*vectors[:50], *vectors[51:], *huge], "vec_id long, embedding array<float>").withColumns({c: top_inner.F.lit(1) for c in ("norm", "v", "block", "score")})
    m = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in vectors if i not in (50,)}
    want = set()
    for q in (i for i in m if i % 50 == 0):
        scored = sorted((-int(m[q] @ m[c]), c) for c in m if c != q)[:5]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in top_inner.search_table(df).collect()} == want
