"""Byte-level BPE encoding and decoding around one global shuffle of distinct words.

Texts are split by the tokenizer's pattern. Per chunk of documents the matches become references, in text order, into
the chunk's own list of distinct words (the positions, kept as a compressed number array), and the list itself is cut
into buckets by word hash. The bucket lists are shuffled, so that each word of the whole table meets one task, which
encodes it once; the ids go back to their chunks, where the references put them in position. Decoding joins the
token-byte table, which is as large as the vocabulary, and concatenates.

A task holds one bucket's distinct words at a time; there are as many buckets as shuffle partitions.

Edge cases: null or empty text has no ids and decodes to no bytes; rows that repeat a doc_id stay separate rows; an
empty table gives an empty result. One document must fit in a task's memory.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binaries, bucketed, rows, values, widened

CHUNK_BYTES = 8 << 20


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """The token-byte table: token bytes and ids, one line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Numbers(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack(words: list[bytes]) -> bytes:
    import zstandard

    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words), 1)


def _unpack(blob: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())] if n else []


CHUNKS = "chunk long, bucket int, blob binary, doc_ids array<long>, doc_words array<long>"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int64()))])


def split_chunks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Per chunk: a row without bucket (references, doc_ids, doc_words) and a row of distinct words per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard

        find, part = regex.compile(pattern).findall, TaskContext.get().partitionId()
        chunk = part << 32

        def flush(ids, counts, numbers, refs):
            coded = [w.encode("utf-8", "surrogatepass") for w in numbers]
            home = np.fromiter((zlib.crc32(w) % buckets for w in coded), np.int32, len(coded))
            order = np.argsort(home, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            blob = zstandard.compress(place[np.concatenate(refs)].tobytes() if refs else b"", 3)
            yield rows(CHUNK_SCHEMA, [chunk], [None], [blob], [ids], [counts])
            edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield rows(CHUNK_SCHEMA, [chunk], [int(home[order[a]])], [_pack([coded[i] for i in order[a:b].tolist()])], [None], [None])

        ids, counts, numbers, refs, size = [], [], Numbers(), [], 0
        for batch in batches:
            for doc_id, text in ((d, t) for b in range(0, batch.num_rows, 500) for d, t in zip(values(batch.slice(b, 500), "doc_id"), values(batch.slice(b, 500), "text"), strict=True)):
                words = find(text or "")
                refs.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id)
                counts.append(len(words))
                size += len(text or "")
                if size >= CHUNK_BYTES:
                    yield from flush(ids, counts, numbers, refs)
                    ids, counts, numbers, refs, size = [], [], Numbers(), [], 0
                    chunk += 1
        if ids:
            yield from flush(ids, counts, numbers, refs)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, CHUNKS)


def encode_words(lists: DataFrame, path: str, pattern: str) -> DataFrame:
    """lists: chunk, bucket, blob of words, with all rows of a bucket in a row. The same rows with a blob of id counts and ids; each word is encoded once in the task that holds its bucket."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
        known: dict[bytes, bytes] = {}
        at = None
        for batch in batches:
            for chunk, bucket, blob in zip(values(batch, "chunk"), values(batch, "bucket"), binaries(batch, "blob"), strict=True):
                words = _unpack(blob)
                if bucket != at:  # buckets have no word in common
                    known.clear()
                    at = bucket
                new = [w for w in words if w not in known]
                known.update((w, np.array(encoding.encode_ordinary(w.decode("utf-8", "replace")), np.uint32).tobytes()) for w in new)
                found = [known[w] for w in words]
                lengths = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                yield rows(schema, [chunk], [bucket], [zstandard.compress(np.uint32(len(found)).tobytes() + lengths.tobytes() + b"".join(found), 1)])

    return lists.mapInArrow(run, "chunk long, bucket int, ids binary")


def _bytes_of(ids: bytes, table: dict[int, bytes]) -> bytes:
    """Ids joined with the token-byte table."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32). docs: doc_id, text.

    decoded: also the bytes that the ids decode to, as decode() gives them, from the same Python worker.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = bucketed(split_chunks(docs, pattern, buckets), "chunks", "chunk", buckets)  # references never move again
    lists = chunks.where("bucket is not null").select("chunk", "bucket", "blob").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    coded = encode_words(lists, path, pattern)
    dictionary = coded.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("lists"))  # a chunk's own words: bounded by its size
    placed = chunks.where("bucket is null").select("chunk", "blob", "doc_ids", "doc_words").join(dictionary.hint("merge"), "chunk", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *([("decoded", pa.binary())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        table = {i: token for token, i in ranks(path).items()} if decoded else {}
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                sizes, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
                for entry in values(one, "lists")[0] or []:
                    data = np.frombuffer(zstandard.decompress(entry["ids"]), np.uint32)
                    sizes.append(data[1 : 1 + data[0]])
                    ids.append(data[1 + data[0] :])
                size, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
                begin = np.cumsum(size) - size
                refs = np.frombuffer(zstandard.decompress(binaries(one, "blob")[0]), np.uint32)
                done = 0
                doc_ids, doc_words, out = values(one, "doc_ids")[0], values(one, "doc_words")[0], []
                for n in doc_words:
                    mine = refs[done : done + n]
                    done += n
                    lengths = size[mine]
                    ends = np.cumsum(lengths)
                    total = int(ends[-1]) if n else 0
                    out.append(flat[np.repeat(begin[mine] - ends + lengths, lengths) + np.arange(total)].astype("<u4").tobytes())
                for b in range(0, len(out), 1000):
                    part = out[b : b + 1000]
                    yield rows(schema, doc_ids[b : b + 1000], [len(x) // 4 for x in part], part, *([[_bytes_of(x, table) for x in part]] if decoded else []))

    return placed.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Adds decoded (bytes) to rows that have ids (little-endian uint32); other columns are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: token for token, i in ranks(path).items()}
        for batch in batches:
            for b in range(0, batch.num_rows, 1000):
                part = batch.slice(b, 1000)
                texts = [_bytes_of(x, table) for x in binaries(part, "ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(run, widened(coded, decoded="binary"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes that they decode to."""
    return encode(docs, path, pattern, decoded=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
