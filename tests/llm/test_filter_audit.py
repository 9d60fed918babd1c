"""Filter interactions against every order tried out on every document."""

import random
import re
from itertools import permutations

import pytest

from strandline.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(250))
SCHEMA = "doc_id long, text string, source string, part string, mask int, n int, rank int, print string, good int"


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    fails = []
    for doc_id, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        f += "E" * any(doc_id is not None and d is not None and d < doc_id and (x or "") == t for d, x, _ in docs)
        fails.append((source or "", f, doc_id))
    rows = set()
    for part in {p for p, _, _ in fails}:
        removed_of, out = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = [(f, d) for p, f, d in fails if p == part]
            for step, x in enumerate(order, 1):
                gone = [(f, d) for f, d in left if x in f]
                left = [(f, d) for f, d in left if x not in f]
                failing = sum(x in f for p, f, _ in fails if p == part)
                removed_of[x] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == x for p, f, _ in fails if p == part), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone), x])
        rows |= {(*r[:-1], removed_of[r[-1]]) for r in out}
    return rows


def frames(spark, docs, labels):
    wide = [(*d, "clash", 7, 7, 7, "clash", 7) for d in docs]
    return spark.createDataFrame(wide, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_intervals_cover_every_order_once():
    for mask in range(1, 32):
        at = sorted((a, b) for m, _, a, b in fa.intervals() if m == mask)
        assert at[0][0] == 0 and at[-1][1] == fa.RANKS and all(x[1] == y[0] for x, y in zip(at, at[1:]))
    orders = list(permutations(range(5)))
    for mask, step, begin, end in fa.intervals():
        assert all(next(i for i, x in enumerate(p, 1) if mask >> x & 1) == step for p in orders[begin:end])


def test_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", LONG, LONG, LONG + " #", LONG.upper(), "a " * 300, "A B C", "one | two", "\x1c  x", LONG + " x" * 3000, *(" ".join(rng.choices(["AB", "c", "d$", "éè", "e"], k=rng.choice([3, 220]))) for _ in range(40))]
    docs = [(i, t, rng.choice(["s", None, "", "other"])) for i, t in enumerate(texts)]
    docs += [(None, LONG, "s"), (2, LONG, "s"), (2, LONG, None), (60, LONG, "s"), (61, "", "s")]  # repeated rows, ties for the smallest
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 62, 2)] + [(3, None, 1), (3, 1, 0), (None, 1, 1), (999, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    got = [tuple(r) for r in fa.audit(*frames(spark, docs, labels)).collect()]
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == brute(docs, labels)


@pytest.mark.parametrize("docs", [[], [(1, "x", "s")]])
def test_few_rows(spark, docs):
    got = fa.audit(*frames(spark, docs, [])).collect()
    assert len(got) == 600 * len(docs) and {tuple(r) for r in got} == brute(docs, [])
