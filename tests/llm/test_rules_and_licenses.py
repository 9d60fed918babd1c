"""Rules over tokens that always come together, and fuzzy notices against full edit tables."""

import itertools
import math
import random
import re
import time

import pytest

from strandline.llm import licenses, url_rules

MPL, ALL = ("mozilla public license version 2 0", "mpl", 3), ("all rights reserved", "p", 1)


# URL rules
def brute(rows, letters, support, confidence, least):
    share, rules = sum(b for _, b in rows) / len(rows), {}

    def evidence(n, k):
        return 2 * (k * math.log(k / (n * share)) + ((n - k) * math.log((n - k) / (n * (1 - share))) if n > k else 0)) if k > n * share else 0

    for n in range(1, len(letters) + 1):
        for s in itertools.combinations(letters, n):
            hit = [b for items, b in rows if set(s) <= set(items)]
            if len(hit) >= max(support * len(rows), url_rules.MIN_COUNT) and sum(hit) >= confidence * len(hit) and evidence(len(hit), sum(hit)) >= least:
                rules[s] = (round(sum(hit) / len(hit), 9), len(hit))
    return {s: v for s, v in rules.items() if not any(t in rules and rules[t][0] >= v[0] for n in range(1, len(s)) for t in itertools.combinations(s, n))}


@pytest.mark.parametrize("seed", [1, 2])
def test_tokens_that_come_together_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        items = [t for t in "abcd" if rng.random() < 0.5] or ["c"]
        bad = ("a" in items and "b" in items) if rng.random() < 0.9 else rng.random() < 0.3
        items += [t.upper() for t in items if t in "ab"] + ["x"] * ("a" in items)  # a, A and x in the same rows, b and B too
        rows.append((items, bad))
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {tuple(r.tokens): (round(r.confidence, 9), r.support) for r in url_rules.mine(df, 0.02, 0.6, 6.0).collect()}
    want = brute(rows, "ABabcdx", 0.02, 0.6, 6.0)
    assert got == want and any(len(s) == 2 for s in got)
    rules, classes = url_rules.mine_items(df, 0.02, 0.6, 6.0)
    assert rules.count() < len(got)
    parts = spark.createDataFrame([(i, f"u{i}", items) for i, (items, _) in enumerate(rows)] + [(9000, "odd", ["a", "B"]), (9001, "none", [])], "page_id long, url string, tokens array<string>")
    found = {r.page_id: r.mined_confidence for r in url_rules.apply_rules(parts, rules, classes).collect()}
    for i, items in [*((i, items) for i, (items, _) in enumerate(rows)), (9000, ["a", "B"]), (9001, [])]:
        best = max((c for t, (c, _) in want.items() if set(t) <= set(items)), default=None)
        assert found[i] == pytest.approx(best) if best else found[i] is None


def test_many_keys_of_equal_urls(spark):
    keys = [f"key:k{i}" for i in range(40)]
    rows = [(keys, True)] * 100 + [(["tail:x"], False)] * 300
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    start = time.time()
    got = {tuple(r.tokens) for r in url_rules.mine(df).collect()}
    assert got == {(k,) for k in keys} and time.time() - start < 60


# licenses
def spans(text, notice, most):
    """(errors, start, end) of the best stretch before each place where one is within the errors."""
    row, out = [(0, -j) for j in range(len(text) + 1)], []
    for i, c in enumerate(notice, 1):
        new = [(i, 0)]
        for j, t in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (c != t), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    for end, (errors, start) in enumerate(row):
        if errors <= most and end > -start:
            out.append((errors, -start, end))
    return out


def best_apart(found):
    """Errors of the best matches without overlap: fewest first, then the first, then the shortest."""
    taken = []
    for errors, a, b in sorted(found):
        if all(b <= x or y <= a for _, x, y in taken):
            taken.append((errors, a, b))
    return taken


def damaged(rng, notice, edits):
    s = list(notice)
    for _ in range(edits):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice([[], [s[k], "x"], ["y"]])
    return "".join(s)


@pytest.mark.parametrize("seed", range(12))
def test_several_damaged_notices_equal_full_tables(seed):
    rng = random.Random(seed)
    text = ""
    for _ in range(rng.randrange(1, 7)):
        notice, _, most = rng.choice([MPL, ALL])
        text += damaged(rng, notice, rng.randrange(0, most + 2)) + rng.choice(["", " ", " some words between them "])
    got = licenses.find_notices(text, (MPL, ALL))
    for i, (notice, _, most) in enumerate((MPL, ALL)):
        want = best_apart(spans(text, notice, most))
        mine = [(a, b, e) for j, a, b, e in got if j == i]
        assert len(mine) == len(want)
        for errors, a, b in want:  # the same places and errors; an edit more or less at an end may be told otherwise
            assert any(e == errors and max(x, a) < min(y, b) for x, y, e in mine)
        assert all(x[1] <= y[0] for x, y in zip(sorted(mine), sorted(mine)[1:]))


def test_neighbours_and_repeats_in_linear_time():
    assert [(a, b, e) for _, a, b, e in licenses.find_notices("all rights reservd all rights reserved", (ALL,))] == [(0, 18, 1), (19, 38, 0)]
    times = []
    for n in (1000, 8000):
        start = time.time()
        assert len(licenses.find_notices("all rights reserved " * n, (ALL,))) == n
        times.append(time.time() - start)
    assert times[1] < 24 * max(times[0], 0.02)


def test_base_places_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["mit", "license", "apache", "general", "public", "MIT", "License", "x"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "é", ""]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [None, "", "mit license " * 30_000, texts[0], texts[0]]
    df = spark.createDataFrame([(i if i != 4 else None, t, 1, "clash", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, labels string, score double")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split())
        r = got[i if i != 4 else None]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(found), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert len(got) == len(texts) and licenses.scan(df.limit(0)).count() == 0
