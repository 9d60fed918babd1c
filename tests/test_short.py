"""Orders of short texts in their task, against those over ranges and against their definitions."""

import random

import numpy as np
import pytest

from strandline.operators import children, short, suffixes
from test_orders import children_of


def dna(n, seed, letters="ACGT"):
    return "".join(random.Random(seed).choices(letters, k=n))


TEXTS = {1: dna(80, 1, "AC"), 2: "A" * 40, 3: "", 4: None, 5: dna(30, 5) * 3, 6: "C", 7: "né日n\U0001f600é日n", 8: dna(200, 3)}


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("within", [50, 1 << 14])
def test_all_tables(spark, monkeypatch, within):
    """Whatever is ordered in its task, and what over ranges."""
    monkeypatch.setattr(short, "WITHIN", within)
    df = spark.createDataFrame(list(TEXTS.items()), "seq_id long, dna string")
    texts = {k: t for k, t in TEXTS.items() if t}
    order = {k: sorted(range(len(t)), key=lambda p, t=t: t[p:]) for k, t in texts.items()}
    lcp = {k: [common(texts[k][p:], texts[k][o[i - 1] :]) if i else 0 for i, p in enumerate(o)] for k, o in order.items()}
    got = {(r.seq_id, r["rank"]): (r.pos, r.lcp) for r in suffixes.prefixed(df, "dna", "seq_id").collect()}
    assert got == {(k, i): (p, lcp[k][i]) for k, o in order.items() for i, p in enumerate(o)}
    got = {(r.seq_id, r["rank"]): (r.up, r.down, r.next_l) for r in children.children(df, "dna", "seq_id").collect()}
    assert got == {(k, i): x for k, v in lcp.items() for i, x in children_of(v).items()}
    three = {k: sorted(range(len(t)), key=lambda p, t=t: (t[p::3], p)) for k, t in texts.items()}
    got = {(r.seq_id, r["rank"]): (r.pos, r.bwt, r.occ_a) for r in suffixes.transformed(df, "dna", "seq_id", 3, counts=True).collect()}
    left = {k: [texts[k][p - 3] if p >= 3 else "$" for p in o] for k, o in three.items()}
    assert got == {(k, i): (p, left[k][i], left[k][: i + 1].count("A")) for k, o in three.items() for i, p in enumerate(o)}
    got = {(r.seq_id, r["head"]): (r["first"], r["last"]) for r in suffixes.blocks(df, "dna", "seq_id", 2, 3).collect()}
    heads = {(k, i): texts[k][p : p + 4 : 3] for k, o in three.items() for i, p in enumerate(o)}
    assert got == {(k, h): (min(i for (j, i), x in heads.items() if (j, x) == (k, h)), max(i for (j, i), x in heads.items() if (j, x) == (k, h))) for (k, _), h in heads.items()}


@pytest.mark.parametrize("limit", [1, 5, 8])
def test_limited_and_cyclic(spark, limit):
    for t in [x for x in TEXTS.values() if x] + [dna(3000, 9) * 2]:
        letters = np.frombuffer(t.encode("utf-32-le"), "<u4")
        assert list(short.doubled(letters, 3, False, limit)[0]) == sorted(range(len(t)), key=lambda p: t[p : p + 3 * limit : 3])
        if len(t) < 500:
            assert list(short.doubled(letters, 1, True)[0]) == sorted(range(len(t)), key=lambda p: t[p:] + t[:p])
    df = spark.createDataFrame(list(TEXTS.items()), "seq_id long, dna string")
    got = {(r.seq_id, r["rank"]): r.pos for r in suffixes.limited_order(df, "dna", "seq_id", limit, 3).collect()}
    assert got == {(k, i): p for k, t in TEXTS.items() if t for i, p in enumerate(sorted(range(len(t)), key=lambda p: t[p : p + 3 * limit : 3]))}


def test_heads_are_told_where_texts_are_read(spark, tmp_path, monkeypatch):
    """An order to search in, of short texts each, joins no heads to it."""
    from strandline.operators import kept

    texts = {1: "ACGTACGTTTACG", 2: "", 3: None, 4: "A", 5: "é😀éAC", 6: "ACAC" * 9}
    df = spark.createDataFrame(list(texts.items()), "seq_id long, dna string")
    monkeypatch.setattr(suffixes, "_heads", lambda *x: pytest.fail("heads are made for all places"))
    kept.build_order(df, "dna", "seq_id", f"file://{tmp_path}", "seq_id")
    got = sorted((r.id, r["rank"], r.pos, r.head) for r in spark.read.parquet(f"file://{tmp_path}/order").collect())
    want = [(k, i, p, t[p : p + kept.HEAD]) for k, t in texts.items() if t for i, p in enumerate(sorted(range(len(t)), key=lambda p: (t[p:], p)))]
    assert got == want
    found = kept.search_order(spark, f"file://{tmp_path}", spark.createDataFrame([("ACAC",), ("AC" * 17,)], "pattern string"), df, "dna", "seq_id")
    assert {(r.pattern, r.seq_id): (r["first"], r["last"]) for r in found.collect()} == {("ACAC", 6): (1, 17), ("AC" * 17, 6): (16, 17)}
