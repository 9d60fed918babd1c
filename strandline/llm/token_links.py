"""Which tokens of two tokenizers stand for the same bytes, and how often an id pair is linked in the corpus.

The byte offsets where tokens of A and of B both end are the keys that two dictionaries (end to index) have in common.
In order, they cut both id lists into groups; all pairs of a group's A and B tokens are links.

Both tokenizers end a token where a character that is no white space meets a space, a tab or a line end, so texts are
cut there into segments, whose groups follow each other. Each task aligns a segment once and then only refers to it. Tasks gather
documents into chunks of CHUNK_BYTES of text: a chunk has its own list of distinct id pairs, with the number of its documents
that link them, and each document's pairs are places in that list. Pairs of all chunks are summed by Spark, each A id's highest count is
joined to them, and counts go back to the chunks that asked. No table of pairs is sent to tasks, and a frequent pair is
one row from each chunk, not one from each document.

Edge cases: null and empty texts, and texts whose tokens don't spell the space and the text (characters that B
reads as a space), have no tokens: zeros and an empty digest; rows that repeat a doc_id are documents of their own and count
as such; a null doc_id stays null; ties for an A id's highest count are all best; very long texts are a chunk of
their own, and one must fit in a task's memory; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binaries, pieces, rows, stored, values
from .token_files import gathered

CHUNK_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
CACHE_SEGMENTS, TOGETHER = 500_000, 4000
#: From one place where a word ends before a space, tab or line end to the next. Carriage returns stay inside, as B has tokens with them.
SEGMENT = re.compile(r"\s+(?:\S+(?:(?![ \n\t])\s+\S+)*(?:(?![ \n\t])\s+\Z)?)?")


def groups(ends_a: Iterable[int], ends_b: Iterable[int]) -> list[tuple[int, int]]:
    """Behind each group: how many tokens of A and of B are done."""
    of_a, of_b = ({end: i for i, end in enumerate(ends, 1)} for ends in (ends_a, ends_b))
    return [(of_a[end], of_b[end]) for end in sorted(of_a.keys() & of_b.keys())]


class Aligned(NamedTuple):
    """The groups of two id lists over the same bytes."""

    done_a: np.ndarray  # tokens of A that are done behind each group
    done_b: np.ndarray
    ends: np.ndarray  # bytes that are done behind each group
    links: np.ndarray  # pairs, A's id in the upper 16 bits
    of_group: np.ndarray  # links of each group


def align(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """a, b: ids; sizes_a, sizes_b: bytes of all ids."""
    ends_a = np.cumsum(sizes_a[a])
    cut = groups(ends_a.tolist(), np.cumsum(sizes_b[b]).tolist())
    done_a, done_b = np.array(cut, np.int64).reshape(-1, 2).T
    n_a, n_b = np.diff(done_a, prepend=0), np.diff(done_b, prepend=0)
    # each A token meets all B tokens of its group
    partners, first = np.repeat(n_b, n_a), np.repeat(done_b - n_b, n_a)
    links = np.repeat(a[: len(partners)].astype(np.uint32) << 16, partners) | b[gathered(np.arange(len(b)), first, partners)]
    return Aligned(done_a, done_b, ends_a[done_a - 1], links, n_a * n_b)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for: printable ones for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Segments(dict):
    """Numbers of aligned segments by text; lives as long as the Python worker and starts anew at CACHE_SEGMENTS."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.bytes_a) > 1 << 16 or len(pieces) > 1 << 16:
            raise ValueError("pairs are kept in 32 bits: both vocabularies must have at most 65,536 ids")
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64) for x in (self.bytes_a, self.bytes_b))
        # of a vocabulary with such tokens, some may cross segments
        self.whole = any(re.search("[^▁]▁|[ \n\t]", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        # an id with what follows it in a digest: one more of its side, the other side, the next group
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{mark}" for i in range(1 << 16)], object) for mark in ",|;")
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.texts: list[str] = []
        self.counts = np.zeros((0, 3), np.int64)  # n_a, n_b, n_groups
        self.links, self.first, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        return [text] if self.whole else SEGMENT.findall(text)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of a text that starts with a space, a tab or a line end. B puts a space of its own in front, which stands alone before the latter two."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text.removeprefix(" "), num_threads=1)
        return np.array(a, np.int64), np.array(b if text[:1] == " " else b[1:], np.int64)

    def spelled(self, a: np.ndarray, b: np.ndarray, text: bytes) -> bool:
        return all(b"".join(map(table.__getitem__, ids.tolist())) == text for table, ids in ((self.bytes_a, a), (self.bytes_b, b)))

    def together(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
        """Segments aligned in one go: for each its groups as text, its n_a, n_b and n_groups, and its links, with how many it has. None if the tokens don't spell them."""
        joined = "".join(new)
        text, (a, b) = joined.encode("utf-8", "replace"), self.ids(joined)
        if not self.spelled(a, b, text):
            return None
        found = align(a, b, self.sizes_a, self.sizes_b)
        ends = np.cumsum(np.fromiter((len(s.encode()) for s in new), np.int64, len(new)))
        upto = np.searchsorted(found.ends, ends) + 1  # groups
        marks_a, marks_b = self.comma[a], self.comma[b]
        marks_a[found.done_a - 1], marks_b[found.done_b - 1] = self.bar[a[found.done_a - 1]], self.semicolon[b[found.done_b - 1]]
        n_a, n_b = np.diff(found.done_a, prepend=0), np.diff(found.done_b, prepend=0)
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + np.repeat(found.done_b - n_b, n_a)] = marks_a
        shown[np.arange(len(b)) + np.repeat(found.done_a, n_b)] = marks_b
        shown, at = shown.tolist(), (found.done_a + found.done_b)[upto - 1].tolist()
        counts = np.stack([found.done_a[upto - 1], found.done_b[upto - 1], upto], axis=1)
        links = np.concatenate([[0], np.cumsum(found.of_group)])[upto]
        return ["".join(shown[x:y]) for x, y in zip([0, *at], at)], np.diff(counts, axis=0, prepend=0), found.links, np.diff(links, prepend=0)

    def learn(self, new: list[str]) -> bool:
        """Keeps the segments, unless the tokens don't spell them."""
        found = self.together(new)
        if found:
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.texts += found[0]
            self.counts, self.links, self.sizes = (np.concatenate(x) for x in ((self.counts, found[1]), (self.links, found[2]), (self.sizes, found[3])))
            self.first = np.cumsum(self.sizes) - self.sizes
        return bool(found)

    def documents(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray] | None]:
        """n_a, n_b, n_groups, digest and all linked pairs of each text; None without tokens."""
        if len(self) > CACHE_SEGMENTS:
            self.clear()
        cut = [self.cut(" " + t) if t else [] for t in texts]
        odd = {i for i, t in enumerate(texts) if "▁" in t or "\x00" in t}  # B may spell these otherwise
        new, strange = list({s for i, segments in enumerate(cut) if i not in odd for s in segments if s not in self}), set()
        # white space at a text's end would join with that of the next segment
        last = [s for s in new if s[-1].isspace()]
        new = [s for s in new if not s[-1].isspace()]
        for some in [*(new[at : at + TOGETHER] for at in range(0, len(new), TOGETHER)), *([s] for s in last)]:
            if not self.learn(some):
                strange.update(s for s in some if not self.learn([s]))
        odd |= {i for i, segments in enumerate(cut) if strange and not strange.isdisjoint(segments)}
        return [self.alone(t) if i in odd else self.known(segments) if segments else None for i, (t, segments) in enumerate(zip(texts, cut, strict=True))]

    def known(self, segments: list[str]) -> tuple[int, int, int, str, np.ndarray]:
        numbers = np.fromiter(map(self.__getitem__, segments), np.int64, len(segments))
        text = "".join(map(self.texts.__getitem__, numbers.tolist()))
        return *self.counts[numbers].sum(axis=0).tolist(), _digest(text), gathered(self.links, self.first[numbers], self.sizes[numbers])

    def alone(self, text: str) -> tuple[int, int, int, str, np.ndarray] | None:
        """By a text's own ids from end to end."""
        found = self.together([" " + text])
        return (*found[1][0].tolist(), _digest(found[0][0]), found[2]) if found else None


def _digest(shown: str) -> str:
    return hashlib.sha256(shown.removesuffix(";").encode()).hexdigest()


@lru_cache(maxsize=1)
def segments_of(path_a: str, path_b: str) -> Segments:
    return Segments(path_a, path_b)


def _chunk(number: int, held: list) -> dict:
    """A row of a chunk: its documents, the distinct pairs that they link, how many hold each, and each document's pairs as places in that list."""
    each = [np.unique(x[4], return_counts=True) if x else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for _, x in held]
    pairs, refs, holders = np.unique(np.concatenate([p for p, _ in each]), return_inverse=True, return_counts=True)
    facts = [x[:4] if x else (0, 0, 0, "") for _, x in held]
    return {
        "chunk": number, "doc_ids": [d for d, _ in held], "n_a": [f[0] for f in facts], "n_b": [f[1] for f in facts], "n_groups": [f[2] for f in facts], "digests": [f[3] for f in facts],
        "n_pairs": [len(p) for p, _ in each], "refs": refs.astype("<u4").tobytes(), "times": np.concatenate([n for _, n in each]).astype("<u4").tobytes(), "pairs": pairs.astype(np.int64), "holders": holders,
    }


LONGS, CHUNK_SCHEMA = pa.list_(pa.int64()), "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, n_pairs array<long>, refs binary, times binary, pairs array<long>, holders array<long>"
ROWS = pa.schema([("chunk", pa.int64()), *((n, LONGS) for n in ("doc_ids", "n_a", "n_b", "n_groups")), ("digests", pa.list_(pa.string())), ("n_pairs", LONGS), ("refs", pa.binary()), ("times", pa.binary()), ("pairs", LONGS), ("holders", LONGS)])


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs: doc_id, text. A row per chunk, as _chunk() says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache, number, held, size = segments_of(path_a, path_b), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                raw = binaries(part, "text")
                texts = [x.decode("utf-8", "replace") for x in raw]
                found = [None if "\ufffd" in t and t.encode() != x else y for x, t, y in zip(raw, texts, cache.documents(texts), strict=True)]
                held += zip(values(part, "doc_id"), found, strict=True)
                size += sum(map(len, raw)) + 100 * len(raw)
                if size >= CHUNK_BYTES:
                    yield rows(ROWS, *([x] for x in _chunk(number, held).values()))
                    number, held, size = number + 1, [], 0
        if held:
            yield rows(ROWS, *([x] for x in _chunk(number, held).values()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNK_SCHEMA)


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair (A's id in the upper bits, B's in the lower 16), n (documents that link it), best (whether no other pair of its A id has more). linked: as chunks() returns them."""
    total = linked.select(F.inline(F.arrays_zip("pairs", "holders"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    most = total.groupBy(F.shiftright("pair", 16).alias("of")).agg(F.max("n").alias("most"))  # at most 65,536 rows: A's vocabulary
    return total.join(F.broadcast(most), F.shiftright("pair", 16) == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _scored(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """A chunk's documents with the counts of its pairs, which come in any order."""
    if not chunk.num_rows:
        return OUT.empty_table()
    row = chunk.to_pylist()[0]
    order = np.argsort(found["pair"].to_numpy())
    n, best = found["n"].to_numpy()[order].astype(np.int64), found["best"].to_numpy()[order].astype(np.int64)
    refs, times = np.frombuffer(row["refs"], "<u4"), np.frombuffer(row["times"], "<u4").astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.array(row["n_pairs"], np.int64))])
    links, good, total = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (times, times * best[refs], times * n[refs]))
    return pa.Table.from_batches([rows(OUT, row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], links, good, total, row["digests"])])


def link(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. docs: doc_id, text."""
    linked = stored(chunks(docs, path_a, path_b), "links")
    counted = stored(pair_counts(linked), "pair-counts")
    asked = linked.select(F.col("chunk").alias("of_chunk"), F.explode("pairs").alias("pair")).join(counted, "pair")
    held = linked.drop("pairs", "holders").groupBy("chunk")
    return held.cogroup(asked.groupBy("of_chunk")).applyInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
