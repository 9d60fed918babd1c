"""Counts of windows summed up in the task that reads the texts: a row a distinct window of many texts, not one a place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.code import ship

#: Letters that are summed up together.
LETTERS = 1 << 22


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, and where each begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.cumsum(sizes) - sizes


def _whole(starts: np.ndarray, sizes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where q letters of one text begin, and the text and the place in it."""
    n = np.maximum(0, sizes - q + 1)
    which = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return starts[which] + off, which, off


def _numbers(letters: np.ndarray, q: int, period: int = 1) -> np.ndarray:
    """A number for q letters, period apart, from each place on, equal where they are."""
    return _shaped(letters, range(0, q * period, period))


def _shaped(letters: np.ndarray, shape: Sequence[int]) -> np.ndarray:
    """A number for the letters so far behind each place, equal where they are."""
    base = int(letters.max(initial=0)) + 1
    out, top = np.zeros(max(0, len(letters) - shape[-1]), np.int64), 1
    for i in shape:
        if top * base >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            top = int(out.max(initial=0)) + 1
        out, top = out * base + letters[i : i + len(out)], top * base
    return out


def _tally(texts: list[str], shapes: list[Sequence[int]]) -> Iterator[pa.RecordBatch]:
    raw, begins = _codes(texts)
    letters, sizes = np.unique(raw, return_inverse=True)[1].astype(np.int64), np.array([len(t) for t in texts], np.int64)
    for k, shape in enumerate(shapes):
        at, which, _ = _whole(begins, sizes, shape[-1] + 1)
        if len(at):
            numbers = _shaped(letters, shape)[at]
            order = np.argsort(numbers, kind="stable")
            numbers, which = numbers[order], which[order]
            new = np.concatenate([[True], numbers[1:] != numbers[:-1]])
            text = new | np.concatenate([[True], which[1:] != which[:-1]])
            first = np.flatnonzero(new)
            spelled = raw[at[order[first]][:, None] + np.array(shape)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            grams = [spelled[i : i + len(shape)] for i in range(0, len(spelled), len(shape))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(grams, pa.string()), pa.array(np.diff(np.append(first, len(numbers)))), pa.array(np.add.reduceat(text, first, dtype=np.int64))], names=["shape", "gram", "n", "n_texts"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Texts, LETTERS of them or so."""
    out, size = [], 0
    for batch in batches:
        for t in batch.column(0).to_pylist():
            out.append(t)
            size += len(t)
            if size >= LETTERS:
                yield out
                out, size = [], 0
    if out:
        yield out


def tallied(df: DataFrame, text: str, shapes: list[Sequence[int]]) -> DataFrame:
    """shape (its number), gram, n, n_texts: how often the letters at a shape's offsets stand, and in how many texts. Texts that a shape doesn't fit in have none."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _together(batches):
            yield from _tally(texts, shapes)

    parts = df.select(text).where(F.length(text) > 0).mapInArrow(run, "shape int, gram string, n long, n_texts long")
    return parts.groupBy("shape", "gram").agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts"))


def shifted_distances(df: DataFrame, text: str, size: int) -> DataFrame:
    """mismatches, n: in how many windows of twice size letters so many of the first half differ from the second."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _together(batches):
            letters, begins = _codes(texts)
            at, _, _ = _whole(begins, np.array([len(t) for t in texts], np.int64), 2 * size)
            upto = np.concatenate([[0], np.cumsum(letters[:-size] != letters[size:])])
            counts = np.bincount(upto[at + size] - upto[at], minlength=size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], names=["mismatches", "n"])

    return df.select(text).where(F.length(text) >= 2 * size).mapInArrow(run, "mismatches long, n long").groupBy("mismatches").agg(F.sum("n").alias("n"))


def gram_classes(df: DataFrame, text: str, size: int, key: str) -> DataFrame:
    """key, class (smallest key with the same grams and counts), total: a row per text that has grams. A text is one row; its grams are counted where it is read."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, prints = [], []
            for t in batch.column(1).to_pylist():
                letters = _codes([t])[0]
                known, letters = np.unique(letters, return_inverse=True)
                # every letter is in a gram, so equal grams have equal letters and numbers
                grams, counts = np.unique(_numbers(letters.astype(np.int64), size), return_counts=True)
                totals.append(int(counts.sum()))
                prints.append(hashlib.blake2b(b"".join(x.astype("<i8").tobytes() for x in (known, grams, counts)), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(prints, pa.binary())], names=[key, "total", "print"])

    prints = df.where(F.length(text) >= size).select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, total long, print binary")
    least = prints.groupBy("total", "print").agg(F.min(key).alias("class"))
    return prints.join(least, ["total", "print"]).select(key, "class", "total")
