"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation estimates, over the
counts of all vote patterns (there are at most 3 ** labellers), the share of good texts and how often each labeller
votes what, silence included, for good and for bad ones, starting from expected votes that then count as BELIEF texts
only; every pattern then has a posterior. A linear scorer over hashed word features is
trained on posteriors of a bounded sample (about SAMPLE rows, chosen by hash, a parameter) and scores all texts.

Edge cases: null or empty text gets the vote of the length labeller and the score of a text without features; rows that
repeat a doc_id are judged each; an empty table gives an empty result; where no labeller votes, the posterior is the
share of good texts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import duplicate_lines, repeated_words
from .shared import binaries, rows, widened

GOOD, BAD, NONE = 1, 0, 2
SAMPLE, BUCKETS, ROUNDS, STEPS, KEEP, KNOWN_WORDS = 6000, 1 << 12, 200, 300, 0.35, 400_000
#: Votes (bad, good, none) expected of a labeller on good and on bad texts, and how many texts of each class that belief counts as, at any number of texts.
EXPECTED_GOOD, EXPECTED_BAD, BELIEF = (0.002, 0.398, 0.6), (0.2, 0.25, 0.55), 10.0
MARKS = b"#*$%&|<>"


def votes(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """Each labeller's vote. LABELLERS names them in order."""
    n = len(words)
    size = max(1, len(text))
    marks = (len(text) - len(text.translate(None, MARKS))) / size
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    shouting = upper / max(1, upper + lower)
    repeat = repeated_words(words) / max(1, n)
    different = len(set(words)) / max(1, n)
    length = sum(map(len, words)) / max(1, n)
    alarm = text.count(b"!!") / max(1, n)
    lines = text.count(b"\n") + 1
    ends = sum(map(text.count, (b". ", b".\n", b", "))) / max(1, n)

    def bad(x, over):
        return BAD if x > over else NONE

    return (
        BAD if n < 10 else NONE,
        bad(marks, 0.04),
        bad(shouting, 0.5),
        bad(repeat, 0.2),
        (BAD if different < 0.25 else GOOD if different > 0.45 else NONE) if n >= 20 else NONE,
        BAD if length > 20 or length < 2 else NONE,
        bad(alarm, 0.2),
        bad(duplicate_lines(text) / lines, 0.3) if lines > 3 else NONE,
        (BAD if ends < 0.02 else GOOD if ends > 0.08 else NONE) if n >= 20 else NONE,
    )


LABELLERS = ("length", "marks", "capitals", "repetition", "variety", "word_length", "exclamation", "lines", "sentences")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, weight: float = BELIEF) -> tuple[np.ndarray, float, np.ndarray]:
    """patterns: rows of votes; counts: texts per row; weight: texts per class that the expected votes count as. Posterior of good per row; share of good; [good or bad, labeller, vote] rates."""
    m = patterns.shape[1] if len(patterns) else len(LABELLERS)
    share, rates = 0.8, np.empty((2, m, 3))
    belief = np.empty((2, 1, 3))
    belief[GOOD], belief[BAD] = EXPECTED_GOOD, EXPECTED_BAD
    rates[:] = belief
    posterior = np.full(len(patterns), share)
    for _ in range(rounds if len(patterns) else 0):
        logs = [np.log(rates[y][np.arange(m), patterns]).sum(axis=1) for y in (BAD, GOOD)]
        gap = np.clip(logs[1] + np.log(share) - logs[0] - np.log(1 - share), -500, 500)
        posterior = 1 / (1 + np.exp(-gap))
        share = float(np.clip((posterior * counts).sum() / counts.sum(), 0.01, 0.99))
        for y, texts in ((GOOD, posterior * counts), (BAD, (1 - posterior) * counts)):
            for vote in (BAD, GOOD, NONE):
                rates[y, :, vote] = ((patterns == vote) * texts[:, None]).sum(axis=0) + weight * belief[y, 0, vote] + 1e-3
            rates[y] /= rates[y].sum(axis=1, keepdims=True)
    return posterior, share, rates


def features(word: bytes) -> list[int]:
    """Buckets of a word: its beginning, its end, and its shape (runs of like characters)."""
    shape, last = bytearray(), 0
    for c in word:
        kind = 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c
        if kind != last:
            shape.append(kind)
            last = kind
    return [zlib.crc32(x) % BUCKETS for x in (b"b" + word[:3], b"e" + word[-3:], b"s" + bytes(shape[:8]))]


def repeats(words: list[bytes]) -> float:
    """Share of words that equal the one before."""
    return sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))


@dataclass
class Scorer:
    """Weights per bucket, of the repeat share, and the constant."""

    weights: np.ndarray
    repeat: float
    constant: float
    id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, words: list[bytes], known: dict[bytes, float]) -> float:
        total = sum(map(known.__getitem__, words)) / max(1, len(words))
        return float(1 / (1 + np.exp(-np.clip(total + self.repeat * repeats(words) + self.constant, -50, 50))))


class WordWeights(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: bytes) -> float:
        value = sum(self.weights[b] for b in features(word))
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


_known: dict[str, WordWeights] = {}


def vote_table(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and weak_pattern: the votes as digits."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 500):
                part = batch.slice(b, 500)
                texts = binaries(part, "text")
                old = [part.column(part.schema.get_field_index(c)) for c in kept]
                new = pa.array(["".join(map(str, votes(t, t.split()))) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*old, new], names=[*kept, "weak_pattern"])

    return docs.mapInArrow(run, widened(docs.select(*kept), weak_pattern="string"))


def posteriors(voted: DataFrame) -> tuple[dict[str, float], int]:
    """Posterior of good per vote pattern, from the counts over all rows; the number of rows."""
    table = voted.groupBy("weak_pattern").agg(F.count("*").alias("n")).toPandas()  # at most 3 ** labellers rows
    patterns = np.array([[int(c) for c in p] for p in table["weak_pattern"]], np.int64).reshape(-1, len(LABELLERS))
    return dict(zip(table["weak_pattern"], estimate(patterns, table["n"].to_numpy(float))[0].tolist(), strict=True)), int(table["n"].sum())


def train(docs: DataFrame, known: dict[str, float], n_rows: int, sample: int = SAMPLE) -> Scorer:
    """docs: doc_id, text, n_rows of them. About sample rows, those with small hashes, train the scorer, each with its pattern's posterior."""
    share = min(1.0, sample / max(1, n_rows))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("text")
    schema = pa.schema([("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("words", pa.int32()), ("repeat", pa.float64()), ("target", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in binaries(batch, "text"):
                words = text.split()
                buckets = np.array([b for w in words for b in features(w)], np.int64)
                at, n = np.unique(buckets, return_counts=True)
                target = known.get("".join(map(str, votes(text, words))), 0.5)
                yield rows(schema, [at.tolist()], [n.tolist()], [max(1, len(words))], [repeats(words)], [target])

    table = chosen.mapInArrow(run, "at array<int>, n array<int>, words int, repeat double, target double").toPandas()  # sample rows at most
    x = np.zeros((len(table), BUCKETS + 2), np.float32)
    for i, (at, n, words, repeat) in enumerate(zip(table["at"], table["n"], table["words"], table["repeat"], strict=True)):
        x[i, np.asarray(at, np.int64)] = np.asarray(n) / words
        x[i, -2:] = repeat, 1
    y = table["target"].to_numpy(np.float32)
    # both classes weigh the same; accelerated gradient steps with a small penalty
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum())).astype(np.float32)
    beta = np.zeros(x.shape[1], np.float32)
    ahead, before = beta.copy(), beta.copy()
    step = 4 / max(1e-6, float((weight * (x**2).sum(axis=1)).sum())) if len(x) else 0.0
    for t in range(STEPS if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        beta = ahead - step * (x.T @ (weight * (p - y)) + 1e-5 * ahead)
        ahead, before = beta + (t / (t + 3)) * (beta - before), beta
    return Scorer(beta[:-2], float(beta[-2]), float(beta[-1]))


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes, posterior, score, kept (score of at least KEEP): a row per row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known, n_rows = posteriors(vote_table(docs))
    shared = docs.sparkSession.sparkContext.broadcast((known, train(docs, known, n_rows, sample)))
    schema = pa.schema([("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, scorer = shared.value
        if scorer.id not in _known:
            _known.clear()
        weights = _known.setdefault(scorer.id, WordWeights(scorer.weights))
        for batch in batches:
            for b in range(0, batch.num_rows, 500):
                part = batch.slice(b, 500)
                texts = [(t, t.split()) for t in binaries(part, "text")]
                patterns = ["".join(map(str, votes(t, w))) for t, w in texts]
                scored = rows(schema, patterns, [posterior.get(p) for p in patterns], [scorer.score(w, weights) for _, w in texts])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *scored.columns], names=["doc_id", *schema.names])

    out = docs.mapInArrow(run, widened(docs.select("doc_id"), votes="string", posterior="double", score="double"))
    return out.withColumn("kept", F.col("score") >= KEEP)
