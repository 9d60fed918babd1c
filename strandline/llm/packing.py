"""Packing token sequences without padding: minimum bin slack over the lengths that remain.

Tasks tokenize their documents as they read them. A document's whole windows are sequences as they stand; what remains
of it (fewer tokens than a window) goes to the task's pool, which holds pieces by length. Whenever the pool has
POOL tokens, and at the end, windows are drawn from it: the longest piece opens a window, and a subset-sum over the
lengths that remain, kept as a bitset with one step per doubling of a length's number, finds the multiset that fills it
closest to its capacity. Going back through the steps gives how many pieces of each length it takes, and that window is
drawn as often as the pool allows. Where no multiset is exact, the slack is filled by the head of one more piece, whose
tail goes back to the pool. What is left at the end of a task is less than a window; it becomes sequences of powers of
two, which need no padding.

So texts don't move between tasks, a pool is bounded however long the table or a run of equal lengths is, and a task
that runs again packs alike. Sequence numbers have the task in their upper bits.

Edge cases: null or empty text has the end id alone; rows that repeat a doc_id, with equal texts or not, are packed as
documents of their own; a null doc_id stays null; ties among pieces of a length go by the order of reading; very long
texts are whole windows and one remainder, and one text must fit in a task's memory; an empty table gives no rows;
other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, rows, values
from .token_files import CACHE_WORDS, PIECE_BYTES, gathered, split_words, word_ids

WINDOW, POOL = 4096, 1 << 20


@dataclass(frozen=True, slots=True)
class Piece:
    """A stretch of a document's ids (little-endian unsigned 32-bit integers)."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def part(self, begin: int, end: int) -> Piece:
        return Piece(self.doc_id, self.start + begin, self.ids[4 * begin : 4 * end], self.doc_tokens)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill the capacity best, with the longest length among them. counts: pieces of each length up to capacity, one at least.

    Bit t of reach says that some multiset has t tokens. Lengths go in from long to short, so that few pieces are taken,
    as often as they fit, by doublings; the search ends once the capacity is reached.
    """
    longest = max(counts)
    target = capacity - longest
    reach, full, steps = 1, 1 << target, []
    mask = 2 * full - 1
    for length in sorted((x for x in counts if x <= target), reverse=True):
        left, times = min(counts[length] - (length == longest), target // length), 1
        while left > 0 and not reach & full:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            left -= times
            times *= 2
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, {longest: 1}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + times
            at -= length * times
    return taken


class Pool:
    """Pieces shorter than a window, by length."""

    def __init__(self, window: int):
        self.window, self.tokens = window, 0
        self.held: dict[int, deque[Piece]] = {}
        self.counts: dict[int, int] = {}

    def add(self, piece: Piece) -> None:
        n = len(piece)
        self.tokens += n
        self.held.setdefault(n, deque()).append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1

    def take(self, length: int) -> Piece:
        self.tokens -= length
        self.counts[length] -= 1
        piece = self.held[length].popleft()
        if not self.counts[length]:
            del self.counts[length], self.held[length]
        return piece

    def fill(self, sequence: list[Piece], room: int, which: Callable) -> None:
        """Room tokens more, from pieces of the length that which names; the last one is cut."""
        while room:
            piece = self.take(which(self.counts))
            if len(piece) > room:
                self.add(piece.part(room, len(piece)))
                piece = piece.part(0, room)
            sequence.append(piece)
            room -= len(piece)

    def windows(self, least: int) -> Iterator[list[Piece]]:
        """Full windows, until fewer than least tokens (a window at least) are left."""
        while self.tokens >= max(least, self.window):
            chosen = fullest(self.counts, self.window)
            while self.tokens >= max(least, self.window) and all(self.counts.get(n, 0) >= k for n, k in chosen.items()):
                window = [self.take(n) for n, k in chosen.items() for _ in range(k)]
                self.fill(window, self.window - sum(map(len, window)), min)
                yield window

    def rest(self) -> Iterator[list[Piece]]:
        """What is left (less than a window) as sequences of powers of two."""
        while self.tokens:
            sequence: list[Piece] = []
            self.fill(sequence, 1 << self.tokens.bit_length() - 1, max)
            yield sequence


def sequences(documents: Iterator[tuple[int | None, bytes]], window: int = WINDOW, pool_tokens: int = POOL) -> Iterator[list[Piece]]:
    """documents: doc_id, ids. Lists of pieces: sequences of window tokens, and a few shorter ones of powers of two at the end."""
    pool = Pool(window)
    for doc_id, ids in documents:
        whole = Piece(doc_id, 0, ids, len(ids) // 4)
        cut = len(whole) // window * window
        for at in range(0, cut, window):
            yield [whole.part(at, at + window)]
        if cut < len(whole):
            pool.add(whole.part(cut, len(whole)))
        if pool.tokens >= pool_tokens:
            yield from pool.windows(pool_tokens // 2)
    yield from pool.windows(window)
    yield from pool.rest()


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, pool_tokens: int = POOL) -> DataFrame:
    """doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset: a row per piece. docs: doc_id, text."""

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        cache, end = word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                words = split_words(part.column(part.schema.get_field_index("text")))
                numbers = cache.numbers(words.flatten())
                lengths = cache.sizes[numbers]
                flat = gathered(cache.flat, cache.first[numbers], lengths).astype("<u4").tobytes()
                stops = (4 * np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(words.value_lengths().to_numpy())]).tolist()
                for doc_id, a, b in zip(values(part, "doc_id"), [0, *stops], stops):
                    yield doc_id, flat[a:b] + end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        number, out = TaskContext.get().partitionId() << 40, []
        for sequence in sequences(tokenized(batches), window, pool_tokens):
            at = 0
            for p in sequence:
                out.append((p.doc_id, p.start, len(p), p.ids, p.doc_tokens, number, at))
                at += len(p)
            number += 1
            if len(out) > 2000:
                yield rows(SCHEMA, *zip(*out, strict=True))
                out = []
        if out:
            yield rows(SCHEMA, *zip(*out, strict=True))

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
