"""Suffix orders of texts that a task holds many of, each ordered where it is read. Longer ones are ordered over ranges, in suffixes.py.

A text of WITHIN characters or fewer needs no shuffle for an order of its own: prefix doubling over its places, in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.sources.code import ship

#: Characters of a text that is ordered in its task; rows of a batch.
WITHIN, SENT = 1 << 14, 1 << 16


def split(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame | None]:
    """Texts of up to WITHIN characters, and longer ones (None if there are none)."""
    long = df.where(F.length(text) > WITHIN)
    return df.where(F.length(text).between(1, WITHIN)), None if long.isEmpty() else long


def doubled(letters: np.ndarray, period: int, cyclic: bool, limit: int | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Places in the order of every period-th letter behind them (limit at most; cyclic: of rotations), equal ones by place; and names of the places by their first so many letters, for each round."""
    n, known = len(letters), 1
    enough = min(limit or n, n if cyclic else -(-n // period))
    names = np.unique(letters, return_inverse=True)[1].astype(np.int64) + 1
    top, rounds = int(names.max()) + 1, [(1, names)]
    while known < enough:
        if top * top >= 1 << 62:
            names = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
            top = int(names.max()) + 1
            if top > n:  # all differ
                break
        step = min(known, enough - known)
        ahead = min(n, step * period)
        further = np.roll(names, -step * period) if cyclic else np.concatenate([names[ahead:], np.zeros(ahead, np.int64)])
        names, known, top = names * top + further, known + step, top * top
        rounds.append((known, names))
    return np.argsort(names, kind="stable"), rounds


def shared(order: np.ndarray, rounds: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """What each suffix in order (of all letters) shares with the one before."""
    n, off = len(order), np.zeros(max(0, len(order) - 1), np.int64)
    for depth, names in reversed(rounds):
        a, b = order[:-1] + off, order[1:] + off
        inside = np.maximum(a, b) < n
        off += depth * (inside & (names[np.where(inside, a, 0)] == names[np.where(inside, b, 0)]))
    return np.concatenate([np.zeros(min(n, 1), np.int64), off])


def children(lcp: np.ndarray) -> list[np.ndarray]:
    """up, down, next_l of every rank, as children.child_table() has them; -1 where there is none."""
    before, stack, values = np.full(len(lcp), -1, np.int64), [], lcp.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            stack.pop()
        if stack:
            before[i] = stack[-1]
            if values[stack[-1]] == v:
                stack.pop()
        stack.append(i)
    up, down, next_l = (np.full(len(lcp), -1, np.int64) for _ in range(3))
    held = np.flatnonzero(before >= 0)
    chain = held[np.argsort(before[held], kind="stable")]
    follows = before[chain[1:]] == before[chain[:-1]]
    up[chain[1:][follows]] = chain[:-1][follows]
    more = lcp[held] > lcp[before[held]]
    for out, some in ((down, held[more]), (next_l, held[~more])):
        out[before[some]] = some  # the last rank stays
    return [up, down, next_l]


def table(df: DataFrame, text: str, key: str, period: int = 1, cyclic: bool = False, limit: int | None = None, prefixes: bool = False, counts: bool = False, links: bool = False, heads: int = 0) -> DataFrame:
    """key, rank, pos, before of every suffix (cyclic: rotation) of df's texts: before is the letter period places before ($ where there is none).

    prefixes: with lcp, as suffixes.common_prefixes() has it. counts: with occ_a, ..., as suffixes.occurrences() has them.
    links: with up, down and next_l, as children.child_table() has them (-1: none). heads: with head, the first so many letters.
    """
    kind = dict(df.dtypes)[key]
    named = [("rank", pa.int64()), ("pos", pa.int64()), ("before", pa.string())] + [("lcp", pa.int64())] * prefixes + [(f"occ_{b.lower()}", pa.int64()) for b in seq.BASES if counts] + [(n, pa.int64()) for n in ("up", "down", "next_l") if links] + [("head", pa.string())] * (heads > 0)
    schema = pa.schema([(key, pa.string() if kind == "string" else pa.int64()), *named])

    def packed(keys: list, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        letters, index = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        spelled = pa.array([chr(c) for c in letters]).take(pa.array(index))
        held = pa.array(keys, schema.field(0).type).take(pa.array(np.repeat(np.arange(len(keys)), [len(p[0]) for p in parts])))
        columns = [pa.array(np.concatenate([p[i] for p in parts]), schema.field(i + 1).type) if i != 2 else spelled for i in range(len(parts[0]))]
        return pa.RecordBatch.from_arrays([held, *columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, n = [], [], 0
        for batch in batches:
            for name, t in zip(*(c.to_pylist() for c in batch.columns)):
                letters = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
                order, rounds = doubled(letters, period, cyclic, limit)
                left = letters[order - period] if cyclic else np.where(order >= period, letters[np.maximum(order - period, 0)], ord("$"))
                columns = [np.arange(len(order)), order, left]
                if prefixes:
                    columns.append(shared(order, rounds))
                if counts:
                    columns += [np.cumsum(left == ord(b)) for b in seq.BASES]
                if links:
                    columns += children(shared(order, rounds))
                if heads:
                    columns.append(np.array([t[p : p + heads] for p in order.tolist()], object))
                keys.append(name)
                parts.append(columns)
                n += len(order)
                if n >= SENT:
                    yield packed(keys, parts)
                    keys, parts, n = [], [], 0
        if parts:
            yield packed(keys, parts)

    ship(df.sparkSession)
    columns = ", ".join(f"{f} {'string' if t == pa.string() else 'long'}" for f, t in [(key, schema.field(0).type), *named])
    # texts are dealt first, as their suffixes are many times their bytes
    found = df.select(F.col(key).cast("string" if kind == "string" else "long").alias(key), text).repartition(key).mapInArrow(run, columns)
    return found.withColumn(key, F.col(key).cast(kind))
