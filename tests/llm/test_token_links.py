"""Links of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandline.llm import token_links as tl

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "\r", "\t \t\n \n", "▁ a", "a ▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "a\r\n\r\nb \r x;\r\n\n\n  y  \t\tz\n", "x\x1cy \x1c z\x85 q  w　 e \xa0 r",
    "ﬁ é́ é 日本 \U0001f600 \x00 a\x00b", "  lead", "tail  ", "tail \n", " \ta", "a\r", "a\r\r b", "it's we'll 'tis 12345 ###", "x" * 3000, "naïve � text", "word, " * 20000,
]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, tl.Segments(A, B)


def plain(libraries, text):
    """Groups as pairs of id lists, or None."""
    a, b, tables = libraries
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a, bytes_b = [tables.bytes_a[i] for i in ids_a], [tables.bytes_b[i] for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
    common, out, i, j = set(ends_a) & set(ends_b), [], 0, 0
    for x, end in enumerate(ends_a, 1):
        if end in common:
            y = j + 1
            while ends_b[y - 1] != end:
                y += 1
            out.append((ids_a[i:x], ids_b[j:y]))
            i, j = x, y
    return out


def brute(libraries, texts):
    found = [plain(libraries, t) for t in texts]
    links = [Counter((p, q) for xs, ys in f or [] for p in xs for q in ys) for f in found]
    count = Counter(pair for x in links for pair in x)
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for f, x in zip(found, links):
        shown = hashlib.sha256(";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in f).encode()).hexdigest() if f else ""
        out.append((sum(len(xs) for xs, _ in f or []), sum(len(ys) for _, ys in f or []), len(f or []), sum(x.values()), sum(n for pair, n in x.items() if count[pair] == best[pair[0]]), sum(n * count[pair] for pair, n in x.items()), shown))
    return out


def texts_of(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioulnrstéñ'", k=rng.randrange(1, 12))) for _ in range(80)] + ["THE", "42", "--", "日本", "don't", "\U0001f600"]
    return ["".join(w + rng.choice([" ", " ", " ", "  ", "\n", ". ", "\r\n", "\t"]) for w in rng.choices(words, k=rng.randrange(1, 120))) for _ in range(n)]


def test_groups():
    assert tl.groups([2, 5, 9], [1, 2, 9]) == [(1, 2), (3, 3)] and tl.groups([], []) == [] and tl.groups([3], [3]) == [(1, 1)]


def test_bytes_of_both_vocabularies(libraries):
    tables = libraries[2]
    assert len(tables.bytes_a) == 50257 and tables.bytes_a[220] == b" " and {bytes([i]) for i in range(256)} <= set(tables.bytes_a)
    assert tables.bytes_b[libraries[1].piece_to_id("<0x0A>")] == b"\n" and tables.bytes_b[libraries[1].piece_to_id("▁")] == b" "
    assert not tables.whole


@pytest.mark.parametrize("chunk", [200, 1 << 22])
def test_against_plain_loops(spark, libraries, monkeypatch, chunk):
    monkeypatch.setattr(tl, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(tl, "TOGETHER", 7)
    texts = ODD + texts_of(1, 40) * 2
    rows = [(i if i != 5 else None, t, 7, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pair string, chunk string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in tl.link(df, A, B).collect()}
    assert got == {i if i != 5 else None: x for i, x in enumerate(brute(libraries, texts))}


def test_repeated_rows_and_empty_table(spark, libraries):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "two")], "doc_id long, text string")
    got = sorted(tuple(r) for r in tl.link(df, A, B).collect())
    want = brute(libraries, ["one two", "one two", "two"])
    assert got == sorted([(1, *want[0]), (1, *want[1]), (2, *want[2])])
    assert tl.link(df.limit(0), A, B).count() == 0


def test_a_small_cache_changes_nothing(libraries, monkeypatch):
    texts = texts_of(2, 30)
    whole = tl.Segments(A, B).documents(texts)
    monkeypatch.setattr(tl, "CACHE_SEGMENTS", 5)
    some = tl.Segments(A, B)
    assert all(x[:4] == y[:4] and (x[4] == y[4]).all() for t, x in zip(texts, whole) for y in some.documents([t]))


def test_vocabulary_whose_tokens_cross_segments(libraries):
    other = tl.Segments(A, B)
    other.whole = True
    texts = [t for t in ODD if t] + texts_of(3, 10)
    for x, y in zip(other.documents(texts), libraries[2].documents(texts)):
        assert (x is None) == (y is None) and (x is None or x[:4] == y[:4] and sorted(x[4]) == sorted(y[4]))
