import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello  World, it's 42 — naïve\n\tcafé", None, "", " \n ", "a\x1cb c d é ́x", "x" * 5000 + " end", "<|endoftext|> q", "same", "same"]
#: Special tokens only as they stand, and characters that compose before they are lower-cased.
RAW = ["<|EndOfText|> x<|endoftext|>y", "J\u030c h\u0331 H\u0331", "T\u0308 W\u030a", "it's. don't, \u00ff\u0178 \u00aa \u00ba \u00b5 \u0130stanbul na\u00efve,*** x&&&y \u00df \u1e9e.", "  lead\x1cx y\u0085 tail \n", "12345.67, .x .. \u65e5\u672c\u8a9e."]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_code_lengths_and_lanes(n):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.3, n).clip(max=10**9)
    lengths = tf.code_lengths(counts)
    assert lengths.max() <= max(tf.MAX_LENGTH, int(n - 1).bit_length())
    assert n == 1 or (0.5**lengths).sum() == 1
    ids = np.sort(rng.choice(n * 3, n, replace=False))
    code = tf.Code(ids, lengths)
    data = rng.choice(ids, 1000 + n)
    checkpoints, payload = code.encode(data)
    assert (code.decode(checkpoints, payload, len(data)) == data).all()


def test_lengths_match_unlimited_huffman():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    heap, total = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    assert (tf.code_lengths(counts) * counts).sum() == total


def test_round_trip(spark):
    df = spark.createDataFrame([(7 * i % 9, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "again", "x")], "doc_id long, text string, ids string")
    got = sorted(tf.round_trip(df, PATH).collect(), key=lambda r: r.start)
    lib = Tokenizer.from_file(PATH)
    expected = {}
    for i, t in enumerate(TEXTS):
        expected.setdefault(7 * i % 9, []).append(t)
    expected[None], expected[3] = ["no id"], expected[3] + ["again"]
    at = 0
    assert [r.doc_id for r in got] == [None, *sorted([7 * i % 9 for i in range(9)] + [3])]
    for r in got:
        want = [np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for t in expected[r.doc_id]]
        assert bytes(r.ids) in want and r.start == at and r.n_tokens == len(r.ids) // 4
        assert zlib.crc32(r.ids) >= 0
        at += r.n_tokens


def test_ids_equal_the_library_on_raw_words(spark, monkeypatch):
    monkeypatch.setattr(tf, "CACHE_WORDS", 5)
    monkeypatch.setattr(tf, "PIECE_BYTES", 40)
    lib = Tokenizer.from_file(PATH)
    texts = RAW * 3
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tf.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    assert got == {i: [*lib.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_one_long_text(spark):
    text = "Some words, and MORE of them. " * 200_000
    row = tf.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    once = Tokenizer.from_file(PATH).encode("Some words, and MORE of them. ", add_special_tokens=False).ids
    assert np.frombuffer(row.ids, "<u4").tolist() == once * 200_000 + [2]


def test_empty_table(spark):
    assert tf.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
