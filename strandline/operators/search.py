"""Online search: exact, multi-pattern, class patterns, edit distance with a pigeonhole filter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.code import ship
from strandline.sources.tables import stored

from . import bands
from .grams import at_places, windows

#: Texts that advance together; what no text holds; letters of patterns that are sent to all tasks.
TOGETHER, NONE, SENT = 512, "\x00", 1 << 22


def find_exact(df: DataFrame, text: str, pattern: str, key: str) -> DataFrame:
    """key, pos: all begins of the pattern, overlapping ones too."""
    return windows(df.where(F.contains(F.col(text), F.lit(pattern))), text, len(pattern), key).where(F.col("gram") == pattern).select(key, "pos")


def find_multi(df: DataFrame, text: str, patterns: DataFrame, key: str, q: int) -> DataFrame:
    """patterns: pattern_id, pattern (q characters or more). pattern_id, key, pos: joined on the first q characters, then compared in full."""
    size, letters = patterns.agg(F.max(F.length("pattern")), F.sum(F.length("pattern"))).first()
    size = size or q
    # texts are padded so that windows of the longest pattern's size cover the short ones at the end
    padded = df.select(key, F.concat(F.col(text), F.lit("\x00" * (size - 1))).alias("padded"))
    places = windows(padded, "padded", size, key).withColumn("head", F.substring("gram", 1, q))
    heads = patterns.withColumn("head", F.substring("pattern", 1, q))
    # Spark takes exploded windows for as small as their texts, so it is told which side is
    met = places.join(F.broadcast(heads), "head") if (letters or 0) <= SENT else places.hint("merge").join(heads, "head")
    return met.where(F.startswith(F.col("gram"), F.col("pattern"))).select("pattern_id", key, "pos")


def find_class(df: DataFrame, text: str, regex: str, size: int, key: str) -> DataFrame:
    """key, pos: windows of size characters that a character-class pattern matches in full; pos is the last character's."""
    return windows(df, text, size, key).where(F.col("gram").rlike(f"^(?:{regex})$")).select(key, (F.col("pos") + size - 1).alias("end_pos"))


def close_pairs(df: DataFrame, text: str, key: str, block: list[str], k: int, length: int) -> DataFrame:
    """a, b, distance: pairs of one block, of texts at least length long, at edit distance k at most.

    Pigeonhole filter: of k + 1 pieces of one text, one stands unchanged in the other, moved by k places at most. Equal texts of a
    block are compared once; only pairs that are near are spelled out for each key. Nothing is broadcast, as Spark takes what is
    spelled out for as small as its texts.
    """
    piece, by = length // (k + 1), [F.col(b) for b in block]
    rows = df.where(F.length(text) >= length).select(*block, F.col(key).alias("id"), F.col(text).alias("t"))
    alike = stored(rows.groupBy(*block, "t").agg(F.count("*").alias("n")), "alike")
    cut = alike.select(*block, "t", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i")).select(*block, F.col("t").alias("s"), "i", F.expr(f"substring(t, i * {piece} + 1, {piece})").alias("piece"))
    places = alike.select(*block, "t", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i")).select(*block, "t", "i", F.explode(F.sequence(F.greatest(F.lit(0), F.col("i") * piece - k), F.col("i") * piece + k)).alias("at")).select(*block, "t", "i", F.expr(f"substring(t, at + 1, {piece})").alias("piece"))
    met = cut.hint("merge").join(places, [*block, "i", "piece"]).where("s < t").select(*block, "s", "t").distinct()
    near = stored(met.withColumn("distance", F.levenshtein("s", "t", k)).where("distance >= 0"), "near")
    same = alike.where("n > 1").select(*by, F.col("t").alias("s"), "t", F.lit(0).alias("distance"))
    both = near.unionByName(near.select(*by, F.col("t").alias("s"), F.col("s").alias("t"), "distance")).unionByName(same)
    first = rows.select(*by, F.col("id").alias("a"), F.col("t").alias("s")).hint("merge").join(both, [*block, "s"])
    return first.hint("merge").join(rows.withColumnRenamed("id", "b"), [*block, "t"]).where("a < b").select("a", "b", "distance")


def _by_columns(df: DataFrame, text: str, pattern: str, key: str, value: str, start: np.ndarray, step, hit) -> DataFrame:
    """key, end_pos and the last cell of each dynamic-programming column that hit() accepts. Texts of like length advance together, a character at a time."""
    codes = np.frombuffer(pattern.encode("utf-32-le"), "<u4")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["k"].to_numpy()
            texts = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in batch["t"]]
            order = np.argsort([len(t) for t in texts], kind="stable")
            for b in range(0, len(order), TOGETHER):
                some = order[b : b + TOGETHER]
                sizes = np.array([len(texts[i]) for i in some])
                column = np.repeat(start[None, :], len(some), axis=0)
                ends, rows, cells = [], [], []
                for j in range(int(sizes[-1])):
                    open_ = int(np.searchsorted(sizes, j, "right"))  # shorter texts are done
                    letters = np.array([texts[i][j] for i in some[open_:]], np.uint32)
                    column[open_:] = step(column[open_:], letters[:, None] == codes[None, :])
                    at = open_ + np.flatnonzero(hit(column[open_:, -1]))
                    rows.append(some[at])
                    ends.append(np.full(len(at), j))
                    cells.append(column[at, -1])
                found = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, ends, cells)]
                yield pd.DataFrame({key: keys[found[0]], "end_pos": found[1], value: found[2]})

    ship(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} long, end_pos long, {value} int")


def find_approximate(df: DataFrame, text: str, pattern: str, k: int, key: str) -> DataFrame:
    """key, end_pos, distance: every end of a substring within edit distance k of the pattern."""
    places = np.arange(len(pattern) + 1)

    def step(column: np.ndarray, same: np.ndarray) -> np.ndarray:
        best = np.minimum(column[:, :-1] + ~same, column[:, 1:] + 1)
        # deletions run down the column: a prefix minimum of value less place
        return np.minimum.accumulate(np.pad(best, ((0, 0), (1, 0))) - places, axis=1) + places

    return _by_columns(df, text, pattern, key, "distance", places, step, lambda x: x <= k)


def find_scored(df: DataFrame, text: str, pattern: str, limit: int, key: str, match: int = 1, mismatch: int = -1, gap: int = -2) -> DataFrame:
    """key, end_pos, score: ends of substrings that align with the whole pattern at a score of limit or more, gaps linear."""
    falls = np.arange(len(pattern) + 1) * gap

    def step(column: np.ndarray, same: np.ndarray) -> np.ndarray:
        best = np.maximum(column[:, :-1] + np.where(same, match, mismatch), column[:, 1:] + gap)
        return np.maximum.accumulate(np.pad(best, ((0, 0), (1, 0))) - falls, axis=1) + falls

    return _by_columns(df, text, pattern, key, "score", falls, step, lambda x: x >= limit)


def find_pieces(df: DataFrame, text: str, patterns: DataFrame, k: int, key: str) -> DataFrame:
    """patterns: pattern_id, pattern (all longer than k). pattern_id, key, end_pos, distance: ends within edit distance k.

    Of k + 1 pieces of a pattern, one stands unchanged where the pattern is within k edits. Pieces are joined with the
    text's windows; around a hit, the pattern is compared in a window that holds every such place. Equal texts are searched once.
    """
    alike = df.where(F.col(text).isNotNull()).select(key, text)
    heads = alike.groupBy(text).agg(F.min(key).alias("one"))
    every, df = alike.join(heads.hint("merge"), text).select("one", key), heads.select(F.col("one").alias(key), text)
    size = F.floor(F.length("pattern") / (k + 1)).cast("int")
    cut = patterns.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn("at", F.col("i") * size).withColumn("piece", F.when(F.col("i") == k, F.expr("substring(pattern, at + 1)")).otherwise(F.substring(F.col("pattern"), F.col("at") + 1, size)))
    q = patterns.agg(F.min(size)).first()[0] or 1
    hits = find_multi(df, text, cut.select(F.struct("pattern_id", "pattern", "at").alias("pattern_id"), F.col("piece").alias("pattern")), key, q)
    m = F.length("pattern_id.pattern")
    begin = F.greatest(F.lit(0), F.col("pos") - F.col("pattern_id.at") - k)
    asked = hits.select(key, "pattern_id.pattern_id", F.col("pattern_id.pattern").alias("pattern"), begin.alias("pos"), (m + 2 * k).cast("int").alias("size")).distinct()
    longest = (patterns.agg(F.max(F.length("pattern"))).first()[0] or 1) + 2 * k
    padded = df.select(key, F.concat(F.col(text), F.lit(NONE * longest)).alias("padded"))
    sites = at_places(asked, padded, "padded", key, longest)
    ship(df.sparkSession)
    verify = sites.select(key, "pattern_id", "pattern", "pos", "site").mapInPandas(_verified(k, key), f"pattern_id {dict(patterns.dtypes)['pattern_id']}, {key} long, end_pos long, distance int")
    found = verify.groupBy("pattern_id", key, "end_pos").agg(F.min("distance").alias("distance"))
    return found.withColumnRenamed(key, "one").join(every.hint("merge"), "one").select("pattern_id", key, "end_pos", "distance")


def _verified(k: int, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pattern, some in batch.groupby("pattern"):
                codes, places = np.frombuffer(pattern.encode("utf-32-le"), "<u4"), np.arange(len(pattern) + 1)
                text = np.stack([np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in some["site"]])
                column = np.repeat(places[None, :], len(text), axis=0)
                for j in range(text.shape[1]):
                    best = np.minimum(column[:, :-1] + (text[:, j, None] != codes), column[:, 1:] + 1)
                    column = np.minimum.accumulate(np.pad(best, ((0, 0), (1, 0))) - places, axis=1) + places
                    at = np.flatnonzero((column[:, -1] <= k) & (text[:, j] != ord(NONE)))
                    out.append(pd.DataFrame({"pattern_id": some["pattern_id"].to_numpy()[at], key: some[key].to_numpy()[at], "end_pos": some["pos"].to_numpy()[at] + j, "distance": column[at, -1]}))
            yield pd.concat(out) if out else pd.DataFrame({"pattern_id": [], key: [], "end_pos": [], "distance": []})

    return run


def wildcards(pattern: str) -> list[tuple[str | None, bool, bool]]:
    """(letters, or None for any; may be left out; may repeat) of each place of a pattern of letters, ., [a-z], and * + ? {n,m} after them."""
    out = []
    for part in re.finditer(r"(\\.|\[[^\]]+\]|.)([*+?]|\{\d+(?:,\d+)?\})?", pattern, re.S):
        item, times = part.groups()
        if item == ".":
            letters = None
        elif item[0] == "[":
            letters = "".join("".join(map(chr, range(ord(a), ord(b) + 1))) if b else c for a, b, c in re.findall(r"(.)-(.)|(.)", item[1:-1], re.S))
        else:
            letters = item[-1]
        low, high = {None: (1, 1), "*": (0, None), "+": (1, None), "?": (0, 1)}.get(times, (0, 0)) if times is None or times[0] != "{" else (lambda n: (int(n[0]), int(n[-1])))(times[1:-1].split(","))
        out += [(letters, False, False)] * low
        if high is None:
            out = [*out[:-1], (letters, False, True)] if low else [*out, (letters, True, True)]
        else:
            out += [(letters, True, False)] * (high - low)
    return out


def find_wildcards(df: DataFrame, text: str, pattern: str, key: str) -> DataFrame:
    """key, end_pos: every place where a substring that matches the pattern ends. The pattern's places are bits of a number that moves on with each character."""
    places = wildcards(pattern)
    may_skip, may_stay = (sum(1 << i for i, p in enumerate(places) if p[n]) for n in (1, 2))
    final = 1 << len(places) - 1

    def entered(bits: int) -> int:
        """Places that may be read next where those before them are done (bit i: place i is next)."""
        while more := (bits & may_skip) << 1 & ~bits & ((final << 1) - 1):
            bits |= more
        return bits

    ends = final
    for i in reversed(range(1, len(places))):  # places that all others behind may leave out are ends too
        if not places[i][1]:
            break
        ends |= 1 << i - 1
    fixed = {c for p in places if p[0] for c in p[0]}
    masks = {c: sum(1 << i for i, p in enumerate(places) if p[0] is None or c in p[0]) for c in fixed}
    other, first = sum(1 << i for i, p in enumerate(places) if p[0] is None), entered(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, found = [], []
            for row_key, t in zip(batch["k"], batch["t"]):
                state = 0
                for j, c in enumerate(t or ""):
                    state = (entered(state << 1) | first | state & may_stay) & masks.get(c, other)
                    if state & ends:
                        keys.append(row_key)
                        found.append(j)
            yield pd.DataFrame({key: keys, "end_pos": found})

    ship(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} long, end_pos long")


def swift_filter(reads: DataFrame, reference: DataFrame, q: int, length: int, rate: float) -> DataFrame:
    """read_id, seq_id, bucket, hits: stretches of parallelogram buckets with enough shared q-grams for a match at the error rate.

    reads: read_id, seq of length bases; reference: seq_id, dna. A hit on diagonal text position less read offset counts
    for the bucket of delta diagonals that holds it, and for the one before where they overlap. Gaps in the text of
    length - q + 1 + errors or more start a new stretch. Hits are counted where blocks of reads and texts meet (bands.py).
    """
    errors = int(rate * length)
    threshold, bits = max(length + 1 - q * (errors + 1), 1), max(4, (errors + 1).bit_length())
    gap = length - (q - 1) + errors
    longest = reads.agg(F.max(F.length("seq"))).first()[0] or 1
    stretch = bands.STRETCH
    own = stretch >> bits  # buckets of a stretch; what lies before a text's begin is its first one's

    def run(asked: bands.Side, blocks: Iterator[bands.Side]) -> Iterator[pa.RecordBatch]:
        for held in blocks:
            yield from counted(asked, held)

    def counted(asked: bands.Side, held: bands.Side) -> Iterator[pa.RecordBatch]:
        for r, piece, bucket, hits, first in bands.shared(asked.texts, held.texts, q, bits, errors, longest - q, gap, lambda _: threshold):
            kept = (bucket < own) & ((bucket >= 0) | (held.kind[piece] == 1))
            piece, bucket, hits, first = piece[kept], bucket[kept], hits[kept], first[kept]
            _, read_ids, _ = asked.spelled(np.array([r]))
            row, seq_ids, at = held.spelled(piece)
            found = pa.RecordBatch.from_arrays([pa.array(seq_ids), pa.array(bucket[row] + at * own), pa.array(hits[row]), pa.array(first[row] + at * stretch)], names=["seq_id", "bucket", "hits", "first_pos"])
            for read_id in read_ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), read_id)), *found.columns], names=["read_id", *found.schema.names])

    asked = reads.where(F.length("seq") >= q).select(F.col("seq").alias("text"), F.lit(0).alias("kind"), F.col("read_id").cast("long").alias("id"), F.lit(0).cast("long").alias("at"))
    texts = reference.select(F.col("seq_id").cast("long").alias("key"), F.col("dna").alias("text"))
    return bands.compared(asked, texts, longest + errors, run, "read_id long, seq_id long, bucket long, hits long, first_pos long")
