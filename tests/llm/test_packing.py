"""Packing against brute force, and what any packing must hold."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def most(counts, capacity):
    """The best sum with the longest length among it, by trying all."""
    reach = {0}
    items = sorted(Counter(counts).elements())
    longest = items.pop()
    for x in items:
        reach |= {r + x for r in reach if r + x <= capacity - longest}
    return longest + max(reach)


@pytest.mark.parametrize("seed", range(30))
def test_fullest_is_closest_to_capacity(seed):
    rng = random.Random(seed)
    capacity = rng.choice([50, 64, 200])
    counts = {rng.randrange(1, capacity): rng.randrange(1, 5) for _ in range(rng.randrange(1, 8))}
    taken = packing.fullest(counts, capacity)
    assert all(0 < k <= counts[n] for n, k in taken.items()) and max(counts) in taken
    assert sum(n * k for n, k in taken.items()) == most(counts, capacity)


def checked(documents, window, pool):
    """Sequences of documents {key: number of ids}; every id in one place, in order, and no padding."""
    ids = {k: np.arange(n, dtype="<u4") + 1000 * k for k, n in documents.items()}
    found = list(packing.sequences(((k, x.tobytes()) for k, x in ids.items()), window, pool))
    parts = defaultdict(list)
    for s in found:
        size = sum(map(len, s))
        assert size == window or size < window and size & (size - 1) == 0
        for p in s:
            assert len(p) and p.doc_tokens == documents[p.doc_id]
            parts[p.doc_id].append((p.start, p.ids))
    for k, x in ids.items():
        assert b"".join(b for _, b in sorted(parts[k])) == x.tobytes()
    return found


@pytest.mark.parametrize("seed", range(10))
def test_every_id_once_without_padding(seed):
    rng = random.Random(seed)
    documents = {i: rng.choice([1, 3, 7, 63, 64, 65, 128, rng.randrange(1, 500)]) for i in range(rng.randrange(0, 300))}
    found = checked(documents, 64, rng.choice([64, 200, 2000]))
    assert sum(sum(map(len, s)) < 64 for s in found) <= 6


def test_one_length_over_and_over():
    found = checked(dict.fromkeys(range(5000), 48), 64, 1024)
    assert len(found) == 5000 * 48 // 64
    assert checked({}, 64, 64) == []


def test_cuts_are_few():
    rng = random.Random(1)
    documents = {i: int(rng.lognormvariate(5, 1)) % 4000 + 1 for i in range(8000)}
    found = checked(documents, 4096, 1 << 18)
    assert sum(map(len, found)) <= 1.05 * (8000 + len(found))  # pieces


def test_spark(spark):
    lib = Tokenizer.from_file(PATH)
    texts = [None, "", "Hello World, it's 42", "same", "same", "x y " * 9000, *(f"doc {i} " * (i * 7 % 900 + 1) for i in range(200))]
    rows = [(i if i != 3 else None, t, 7, 7, "clash") for i, t in enumerate(texts)] + [(1, "again", 7, 7, "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, offset int, ids string").repartition(3)
    want = Counter((d, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t, *_ in rows)
    got = packing.pack(df, PATH).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 > 0
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for s in by_sequence.values():
        size = sum(n for _, n in s)
        assert size == 4096 or size < 4096 and size & (size - 1) == 0
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
    for doc_id, n in Counter(d for d, *_ in rows).items():
        if n == 1:
            parts = sorted(by_doc[doc_id], key=lambda r: r.start)
            assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
            assert (doc_id, b"".join(bytes(p.ids) for p in parts)) in want and parts[0].doc_tokens == sum(p.length for p in parts)
    assert sum(p.length for p in by_doc[1]) == sum(len(b) // 4 * k for (d, b), k in want.items() if d == 1)
    assert packing.pack(df.limit(0), PATH).count() == 0
