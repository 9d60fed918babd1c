"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to Latin letters, drops invisible characters and turns all
else that is no letter into single blanks. Lexicon entries are whole words and word beginnings whose share of toxic
documents is far above the rest's (smoothed log odds, with a likelihood ratio that chance among many rare words does not reach). Exception phrases are the two-word phrases
around an entry that mostly stand in documents that aren't toxic; each cancels its entry's weight. The weight sum,
divided by a slowly growing function of the length, goes through a logistic curve fitted to the labels.

The lexicon's bytes are counted where it is, in a table, before anything is collected. Up to MAX_LEXICON_BYTES it is sent to
all tasks and matched by Aho-Corasick; a larger one stays a table that distinct words and phrases are joined to (Tables),
with the same sums.

Edge cases: null or empty text scores as a text without any entry; labels that are null are left out; without labels of
both kinds the lexicon is empty and every score equals the curve's default; rows that repeat a doc_id are scored by their
own texts; very long texts are matched whole (one must fit in a task's memory); an empty table gives an empty result; columns
that are kept may have any names, as they travel in a struct.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pieces, rows, stored, values, widened

MIN_SUPPORT, MIN_WEIGHT, MIN_EVIDENCE, STEMS, THRESHOLD = 3, 2.5, 30.0, (4, 5, 6), 0.7
EXCEPTION_SUPPORT, EXCEPTION_SHARE, BINS, MAX_SENT_IDS, MAX_LEXICON_BYTES = 5, 0.1, 400, 1_000_000, 32 << 20
#: Look-alikes: Cyrillic and Greek letters, digits and signs that stand for Latin letters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = ("­", "​", "‌", "‍", "⁠", "﻿")


class Fold(dict):
    """str.translate table, filled as characters appear."""

    def __init__(self):
        super().__init__({ord(a): b for a, b in (LOOKALIKES | SUBSTITUTES).items()} | {ord(c): None for c in INVISIBLE})

    def __missing__(self, code: int):
        c = chr(code)
        self[code] = value = c if c.isalpha() or unicodedata.combining(c) else " "
        return value


_FOLD = Fold()


def fold(text: str) -> str:
    """Folded words, joined by single blanks."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.lower().translate(_FOLD).split())


def entries(word: str) -> list[str]:
    """Lexicon entries that a word may match: itself, and its beginnings (marked by the missing blank at the end)."""
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) > n)]


@dataclass
class Lexicon:
    """Entry weights, exception phrases, and the curve."""

    weights: dict[str, float]
    exceptions: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = -3.0
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for text, weight in self.weights.items():
                self._automaton.add_word(text, (text, weight))
            for text, weight in self.exceptions.items():
                self._automaton.add_word(text, (text, weight))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(position of the last character, entry, weight) in the folded text with a blank at either end."""
        found = self.automaton()
        return [(end, *value) for end, value in found.iter(f" {folded} ")] if len(found) else []

    def raw(self, folded: str) -> float:
        """Weight sum over words (each word by its heaviest entry) and exceptions, over 1 + log(1 + words) / 10."""
        best: dict[int, float] = {}
        total = 0.0
        for end, entry, weight in self.hits(folded):
            if weight < 0:
                total += weight
            else:
                at = end - len(entry)
                best[at] = max(best.get(at, 0.0), weight)
        total += sum(best.values())
        return max(0.0, total) / (1 + math.log1p(folded.count(" ") + 1) / 10)

    def raws(self, docs: DataFrame, column: str) -> DataFrame:
        """docs without text, with raw() of the text in a column."""
        shared = docs.sparkSession.sparkContext.broadcast(self)
        kept = docs.drop("text")
        names = kept.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text", 4 << 20):
                    found = pa.array([shared.value.raw(fold(t or "")) for t in values(part, "text")], pa.float64())
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), found], names=[*names, column])

        return docs.mapInArrow(run, widened(kept, **{column: "double"}))

    def score(self, folded: str) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.raw(folded) + self.shift))))


@dataclass
class Tables:
    """A lexicon beyond what tasks are sent: weights (entry, weight) and exceptions (entry, weight) as written tables, and the curve."""

    weights: DataFrame
    exceptions: DataFrame | None = None
    slope: float = 1.0
    shift: float = -3.0

    def words(self, terms: DataFrame) -> DataFrame:
        """terms: term (a word between blanks), distinct. term, weight of its heaviest entry, where it has one."""
        word = F.trim("term")
        of = F.concat(F.array("term"), *(F.when(F.length(word) > n, F.array(F.concat(F.lit(" "), F.left(word, F.lit(n))))).otherwise(F.array()) for n in STEMS))
        return terms.select("term", F.explode(of).alias("entry")).join(self.weights, "entry").groupBy("term").agg(F.max("weight").alias("weight"))

    def raws(self, docs: DataFrame, column: str) -> DataFrame:
        """As Lexicon.raws: each text's distinct words and phrases are joined to the tables, rows told apart by their place in a written table."""
        docs = stored(docs, "texts")
        kept = docs.withColumn("__row", F.monotonically_increasing_id())
        terms = stored(_terms(kept.select(F.col("__row").alias("row"), "text")), "terms")
        single = terms.where("not phrase")
        weights = self.words(single.select("term").distinct())
        if self.exceptions is not None:
            weights = weights.unionByName(self.exceptions.select(F.col("entry").alias("term"), "weight"))
        total = terms.join(weights, "term").groupBy("row", "words").agg(F.sum(F.col("n") * F.col("weight")).alias("total"))
        raw = F.greatest(F.lit(0.0), F.col("total")) / (1 + F.log1p(F.col("words")) / 10)
        found = total.select(F.col("row").alias("__row"), raw.alias(column))
        return kept.drop("text").join(found, "__row", "left").drop("__row").fillna(0.0, [column])


def _terms(docs: DataFrame) -> DataFrame:
    """docs: row, text. row, term, phrase (whether it has two words), n, words (of the text): distinct folded words and pairs of neighbours, between blanks."""
    schema = pa.schema([("row", pa.int64()), ("term", pa.string()), ("phrase", pa.bool_()), ("n", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                out = []
                for row, text in zip(values(part, "row"), values(part, "text"), strict=True):
                    words = fold(text or "").split()
                    out += [(row, f" {w} ", False, n, len(words)) for w, n in Counter(words).items()]
                    out += [(row, f" {v} {w} ", True, n, len(words)) for (v, w), n in Counter(zip(words, words[1:])).items()]
                yield rows(schema, *zip(*out, strict=True)) if out else rows(schema, *[[]] * 5)

    return docs.mapInArrow(run, "row long, term string, phrase boolean, n long, words long")


def _large(table: DataFrame) -> bool:
    """Whether a written table of entries has more than MAX_LEXICON_BYTES, with 64 for what a task holds beside each."""
    return (table.agg(F.sum(F.octet_length("entry") + 64)).first()[0] or 0) > MAX_LEXICON_BYTES


def _needed_rows(chosen: DataFrame) -> DataFrame:
    """_needed() over a table: entry, toxic, weight."""
    stems = F.concat(*(F.when(F.length("entry") > n + 1, F.array(F.left("entry", F.lit(n + 1)))).otherwise(F.array()) for n in STEMS))
    most = chosen.select("toxic", F.explode(stems).alias("entry")).groupBy("entry").agg(F.max("toxic").alias("most"))
    return chosen.join(most, "entry", "left").where(F.coalesce("most", F.lit(0)) < 0.9 * F.col("toxic")).select("entry", "weight")


def _tabled(labelled: DataFrame, chosen: DataFrame) -> Tables:
    """learn() for a lexicon beyond what tasks are sent."""
    lexicon = Tables(stored(_needed_rows(chosen), "entries"))
    known = stored(labelled.select(F.col("text").cast("string").alias("text"), "toxic"), "labelled").withColumn("row", F.monotonically_increasing_id())
    phrases = _terms(known.select("row", "text")).where("phrase").join(known.select("row", "toxic"), "row")
    counted = phrases.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    counted = stored(counted.where((F.col("clean") >= EXCEPTION_SUPPORT) & (F.col("toxic") <= EXCEPTION_SHARE * F.col("clean"))).select("term"), "phrases")
    each = counted.select(F.col("term").alias("phrase"), F.explode(F.transform(F.split(F.trim("term"), " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))).alias("term"))
    held = each.join(lexicon.words(each.select("term").distinct()), "term").groupBy("phrase").agg(F.max("weight").alias("held"))
    lexicon.exceptions = stored(held.select(F.col("phrase").alias("entry"), (-F.col("held")).alias("weight")), "exceptions")
    return fitted(labelled, lexicon)


def _counted(labelled: DataFrame, run) -> DataFrame:
    return labelled.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _tally(found) -> callable:
    """Task-side counts of found(text), toxic and clean documents apart, sent on at a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entry", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
        held = (Counter(), Counter())

        def sent():
            names = list(held[0].keys() | held[1].keys())
            return rows(schema, names, [held[1][n] for n in names], [held[0][n] for n in names])

        for batch in batches:
            for toxic, text in zip(values(batch, "toxic"), values(batch, "text"), strict=True):
                held[toxic].update(found(text or ""))
                if len(held[0]) + len(held[1]) > 300_000:
                    yield sent()
                    held = (Counter(), Counter())
        yield sent()

    return run


def _needed(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Without the beginnings whose toxic documents one longer entry accounts for, by nine in ten."""
    most: dict[str, int] = {}
    for entry, (_, toxic) in found.items():
        for n in STEMS:
            if len(entry) > n + 1:
                most[entry[: n + 1]] = max(most.get(entry[: n + 1], 0), toxic)
    return {e: w for e, (w, toxic) in found.items() if most.get(e, 0) < 0.9 * toxic}


def learn(labelled: DataFrame) -> Lexicon | Tables:
    """labelled: text, toxic (0 or 1). Counts are over all rows, and all entries and phrases that pass the tests are kept."""
    labelled = labelled.where("toxic in (0, 1)")
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Lexicon({})

    def words(text):
        seen = set(fold(text).split())
        return {e for w in seen for e in entries(w)}

    # entries of toxic documents only can enter; the clean ones are counted for these alone
    counted = _counted(labelled, _tally(words)).where(F.col("toxic") >= MIN_SUPPORT)
    weight = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    both, share = F.col("toxic") + F.col("clean"), bad / (bad + good)
    evidence = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0))
    chosen = stored(counted.withColumn("weight", weight).where((F.col("weight") >= MIN_WEIGHT) & (evidence >= MIN_EVIDENCE) & (F.col("toxic") > F.col("clean"))), "chosen")
    if _large(chosen):
        return _tabled(labelled, chosen)
    table, chosen = chosen, chosen.toPandas()
    lexicon = Lexicon(_needed(dict(zip(chosen["entry"], zip(chosen["weight"].astype(float), chosen["toxic"], strict=True), strict=True))))
    if not lexicon.weights:
        return lexicon
    shared = labelled.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(text):
        padded = f" {fold(text)} "
        out = set()
        for end, entry, _ in shared.value.hits(padded[1:-1]):
            start = end - len(entry) + 1
            stop = padded.find(" ", start + 1)
            before, after = padded.rfind(" ", 0, start), padded.find(" ", stop + 1)
            if start > 0 and before >= 0:
                out.add(padded[before : stop + 1])
            if after > 0:
                out.add(padded[start : after + 1])
        return out

    around = stored(_counted(labelled, _tally(phrases)).where((F.col("clean") >= EXCEPTION_SUPPORT) & (F.col("toxic") <= EXCEPTION_SHARE * F.col("clean"))), "around")
    if _large(around):
        return _tabled(labelled, table)
    for phrase in around.toPandas()["entry"]:
        held = max((w for _, e, w in lexicon.hits(phrase.strip()) if w > 0), default=0.0)
        lexicon.exceptions[phrase] = -held
    return fitted(labelled, lexicon)


def fitted(labelled: DataFrame, lexicon: Lexicon | Tables) -> Lexicon | Tables:
    """The curve: logistic regression, with a small penalty, on counts per BINS bins of the normalised sum."""
    found = lexicon.raws(labelled.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")), "raw")
    place = F.least(F.lit(BINS - 1), F.floor(10 * F.col("raw"))).cast("int").alias("place")
    table = found.groupBy("toxic", place).agg(F.count("*").alias("n")).toPandas()  # two rows a bin at most
    x, y, n = np.minimum(table["place"].to_numpy() / 10, 8.0), table["toxic"].to_numpy(), table["n"].to_numpy().astype(float)
    beta, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (n * (y - p)) - 1e-4 * n.sum() * np.array([beta[0], 0])
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-4 * n.sum(), 1e-9 * n.sum() + 1e-9])
        beta = beta + np.linalg.solve(curve, slope)
    return replace(lexicon, slope=float(beta[0]), shift=float(beta[1]), **({"_automaton": None} if isinstance(lexicon, Lexicon) else {}))


def score(docs: DataFrame, lexicon: Lexicon | Tables, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc (a struct of the columns of docs named in keep) and toxicity, 0 to 1: a row per row of docs."""
    chosen = docs.select(F.struct(*keep).alias("doc"), F.col("text").cast("string").alias("text"))
    at = F.least(F.lit(50.0), F.greatest(F.lit(-50.0), lexicon.slope * F.col("toxicity") + lexicon.shift))
    return lexicon.raws(chosen, "toxicity").select("doc", (1 / (1 + F.exp(-at))).alias("toxicity"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train_and_score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learns from the labels of rows that aren't held out and scores all rows: doc (a struct of the columns named in keep) and toxicity. labels: doc_id, toxic."""
    known = labels.where(F.col("toxic").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known, "labels")
    few = known.count() <= MAX_SENT_IDS  # more labels than that are shuffled, and the labelled texts written once
    labelled = docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id").select("text", "toxic")
    labelled = labelled if few else stored(labelled, "labelled")
    return score(docs, learn(labelled), keep)
