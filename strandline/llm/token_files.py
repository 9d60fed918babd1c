"""Token-id files: canonical length-limited Huffman codes from global counts.

A file set is a folder with two tables. ``code`` has a row (id, length) per used id; the codes follow from it
canonically (by length, then id). ``blocks`` has a row per segment of whole documents in ascending doc_id order:
part and seq order the segments, start is the number of ids before the segment, doc_ids and doc_tokens name its
documents, checkpoints holds the bit offset of every BLOCK-th id, payload the bits as big-endian 32-bit words.
Each block can be decoded alone from its checkpoint; reading decodes all blocks of a segment side by side.

Edge cases: null text is empty (only the end id is written); null doc_id sorts first; rows that repeat a doc_id are
kept, ordered by text hash; an empty table gives empty files. One document must fit in a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import binaries, pieces, rows, scratch, stored, values

BLOCK = 256
SEGMENT_IDS = 1 << 17
MAX_LENGTH = 18
CACHE_WORDS, PIECE_BYTES = 600_000, 8 << 20


#: Marks that the tokenizer makes a token of their own where they follow a letter, and stems that it keeps whole and lower-cases letter by letter.
TAIL, PLAIN = r"(?s)^(?P<stem>.*?)(?P<tail>[.,;:!?*#$%&|]*)$", "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


class WordIds(dict):
    """Numbers words as they come; their ids stand in a flat array, from first[number] on, sizes[number] of them.

    Lives as long as the Python worker. At CACHE_WORDS words it starts anew, so memory is bounded. Words are raw: the
    tokenizer looks for special tokens and composes characters before it lower-cases. Stems of plain Latin letters are
    spelled in the tokenizer's byte alphabet and encoded many at a time, told apart by the sign that ends a word's last
    token; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # byte-level vocabularies: printable characters stand for themselves, the other bytes for those from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.spelling = np.arange(256, dtype="<u4")
        self.spelling[hidden] = 256 + np.arange(len(hidden))
        self.spelling[32] = 32
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.flat, self.sizes, self.first = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _together(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stems of plain letters, and how many each has."""
        codes = np.frombuffer(" ".join(stems.to_numpy(zero_copy_only=False)).lower().encode(), np.uint8)
        text = self.spelling[codes].tobytes().decode("utf-32-le")
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _apart(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of words, after encoding those that are new."""
        coded = words.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in known if w not in self]
        if new:
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self._learn(pa.array(new, pa.string()))
        place = np.fromiter(map(self.__getitem__, known), np.int64, len(known))
        return place[coded.indices.to_numpy()]

    def _learn(self, new: pa.Array) -> None:
        cut = pc.extract_regex(new, TAIL)
        plain = pc.match_substring_regex(cut.field("stem"), PLAIN)
        stems, others = cut.field("stem").filter(plain).dictionary_encode(), new.filter(pc.invert(plain))
        tails = pc.if_else(plain, cut.field("tail"), "").dictionary_encode()
        parts = [self._together(stems.dictionary), self._apart(others), self._apart(tails.dictionary)]
        flat, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        head, mask = np.empty(len(new), np.int64), plain.to_numpy(zero_copy_only=False)
        head[mask], head[~mask] = stems.indices.to_numpy(), len(stems.dictionary) + np.arange(len(others))
        piece = np.stack([head, len(stems.dictionary) + len(others) + tails.indices.to_numpy()], axis=1)
        lengths, begin = sizes[piece], np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, gathered(flat, begin[piece].ravel(), lengths.ravel())])
        self.sizes = np.concatenate([self.sizes, lengths.sum(axis=1)])
        self.first = np.cumsum(self.sizes) - self.sizes


def gathered(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at begin, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def split_words(texts: pa.Array) -> pa.Array:
    """Lists of words between ASCII white space. Plain ASCII is lower-cased first: nothing in it composes, and no special token starts."""
    texts = texts.cast(pa.string()).fill_null("")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())
    plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
    return pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(texts), texts))


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, part, local_start, n_tokens, ids (little-endian uint32) in ascending doc_id order within and across parts.

    The tokenizer drops white space and no token crosses it, so a text's ids are the ids of its words in order; each
    word is encoded once per cache. docs: doc_id, text.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = word_ids(tokenizer_path)
        end, at, part = np.array([end_id], "<u4").tobytes(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                words = split_words(piece.column(piece.schema.get_field_index("text")))
                counts, numbers = words.value_lengths().to_numpy(), cache.numbers(words.flatten())
                lengths = cache.sizes[numbers]
                flat = gathered(cache.flat, cache.first[numbers], lengths).astype("<u4").tobytes()
                stop = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
                ids = [flat[4 * x : 4 * y] + end for x, y in zip([0, *stop[:-1].tolist()], stop.tolist())]
                sizes = np.diff(stop, prepend=0) + 1
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield rows(schema, values(piece, "doc_id"), np.full(len(ids), part, np.int32).tolist(), starts.tolist(), sizes.tolist(), ids)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids binary")


def count_ids(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """id, n over all rows; each task sends at most one row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in binaries(batch, "ids"):
                total += np.bincount(np.frombuffer(x, "<u4"), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most limit bits, by package-merge. counts: positive, in any order."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, leaf_flags = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        by_weight = np.argsort(both, kind="stable")
        level = both[by_weight]
        leaf_flags.append(by_weight < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(leaf_flags):
        taken = int(flags[:take].sum())
        lengths[:taken] += 1
        take = 2 * (take - taken)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of the given ids and lengths, with its encoding arrays and its decoding table."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.bits = int(self.lengths.max()) if len(order) else 1
        widths = np.int64(1) << (self.bits - self.lengths)
        codes = (np.cumsum(widths) - widths) >> (self.bits - self.lengths)
        size = int(self.ids.max()) + 1 if len(order) else 0
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids], self.length_of[self.ids] = codes.astype(np.uint64), self.lengths
        self.decode_id = np.zeros(1 << self.bits, np.uint32)
        self.decode_length = np.ones(1 << self.bits, np.int64)
        total = int(widths.sum())
        self.decode_id[:total] = np.repeat(self.ids, widths)
        self.decode_length[:total] = np.repeat(self.lengths, widths)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offset of every BLOCK-th id; the bits."""
        lengths = self.length_of[ids]
        ends = np.cumsum(lengths)
        at = ends - lengths
        word = at >> 5
        shifted = self.code_of[ids] << (64 - (at & 31) - lengths).astype(np.uint64)
        size = (int(ends[-1]) + 31 >> 5) + 1 if len(ids) else 0
        high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), size)
        low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        return at[::BLOCK], (high + low[:size])[:size].astype(np.uint64).astype(">u4").tobytes()

    def decode(self, checkpoints: np.ndarray, payload: bytes, n: int) -> np.ndarray:
        """All n ids; one lane per block, every lane reads its next id from the table at each step."""
        words = np.concatenate([np.frombuffer(payload, ">u4"), [0, 0]]).astype(np.uint64)
        at = np.array(checkpoints, np.int64)
        out = np.zeros((BLOCK, len(at)), np.uint32)
        last, mask, bits = len(words) - 2, np.uint64((1 << self.bits) - 1), 64 - self.bits
        for step in range(min(BLOCK, n)):
            w = np.minimum(at >> 5, last)
            window = (words[w] << np.uint64(32)) | words[w + 1]
            key = ((window >> (bits - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)
            out[step] = self.decode_id[key]
            at += self.decode_length[key]
        return out.T.reshape(-1)[:n]


def write_ids(tokens: DataFrame, path: str, vocabulary: int) -> None:
    """tokens: as tokenize() returns them, in a written table. Writes path/code and path/blocks."""
    spark = tokens.sparkSession
    counts = count_ids(tokens, vocabulary).toPandas()  # at most one row per id of the vocabulary
    lengths = code_lengths(counts["n"].to_numpy())
    spark.createDataFrame(list(zip(counts["id"].tolist(), lengths.tolist(), strict=True)), "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per part
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    shared = spark.sparkContext.broadcast((counts["id"].to_numpy(), lengths))
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)

        def segment(docs):
            checkpoints, payload = code.encode(np.frombuffer(b"".join(d[4] for d in docs), "<u4"))
            return rows(schema, [docs[0][0]], [docs[0][1]], [[d[2] for d in docs]], [[d[3] for d in docs]], [checkpoints.tolist()], [payload])

        held, size = [], 0
        for batch in batches:
            for doc in zip(values(batch, "part"), values(batch, "start"), values(batch, "doc_id"), values(batch, "n_tokens"), binaries(batch, "ids"), strict=True):
                if held and (size >= SEGMENT_IDS or doc[1] != held[-1][1] + held[-1][3]):
                    yield segment(held)
                    held, size = [], 0
                held.append(doc)
                size += doc[3]
        if held:
            yield segment(held)

    placed = tokens.join(F.broadcast(before), "part").select("part", (F.col("part_start") + F.col("local_start")).alias("start"), "doc_id", "n_tokens", "ids")
    out = placed.mapInArrow(run, "part int, start long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, payload binary")
    out.write.option("compression", "none").parquet(f"{path}/blocks")  # the payload is entropy-coded already


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of all documents in the files."""
    code_rows = spark.read.parquet(f"{path}/code").toPandas()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((code_rows["id"].to_numpy(), code_rows["length"].to_numpy()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for batch in batches:
            for start, docs, sizes, checkpoints, payload in zip(values(batch, "start"), values(batch, "doc_ids"), values(batch, "doc_tokens"), values(batch, "checkpoints"), binaries(batch, "payload"), strict=True):
                ends = np.cumsum(sizes)
                data = code.decode(np.array(checkpoints), payload, int(ends[-1])).astype("<u4").tobytes()
                begins = ends - sizes
                yield rows(schema, docs, (start + begins).tolist(), sizes, [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])

    return spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "doc_tokens", "checkpoints", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, vocabulary: int = 49408, end_id: int = 2) -> DataFrame:
    """Tokenize, write the files in the shared folder, read them back: doc_id, start, n_tokens, ids."""
    path = scratch(docs.sparkSession, "token-files")
    write_ids(stored(tokenize(docs, tokenizer_path, end_id), "tokens"), path, vocabulary)
    return read_ids(docs.sparkSession, path)
