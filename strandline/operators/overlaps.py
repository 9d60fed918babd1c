"""Pairs of texts that share many q-grams, found where two blocks of texts meet.

Shared q-grams are the square of the input, so neither they nor the pairs that have some are rows of a table. Texts are put in
order of their number of q-grams and cut into blocks of a bounded size, a row each; a task reads two of those rows, which are
written once. Only pairs that are similar leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.code import ship
from strandline.sources.tables import stored

from . import tallies
from .streams import global_starts

#: Letters of a block, of the smallest blocks, and blocks that a small table is cut into.
LETTERS, FEWEST, BLOCKS = 1 << 22, 1 << 17, 8
#: Cells of a table of sums, and places of q-grams that are added to it at once.
CELLS, PAIRS = 1 << 22, 1 << 20


def _grams(texts: list[str], q: int) -> tuple[np.ndarray, ...]:
    """q-gram (a number from 0), text and count of each q-gram of each text, in this order."""
    letters, begins = tallies._codes(texts)
    known = np.bincount(letters) > 0
    letters = (np.cumsum(known) - 1)[letters]
    numbers = tallies._numbers(letters, q)
    sizes = np.array([len(t) for t in texts], np.int64)
    which = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[: len(numbers)]
    inside = np.arange(len(numbers)) + q <= np.repeat(begins + sizes, sizes)[: len(numbers)]
    numbers, which = numbers[inside], which[inside]
    del letters, inside
    if int(numbers.max(initial=0)) >= (1 << 62) // max(1, len(texts)):
        numbers = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    numbers *= len(texts)
    numbers += which
    numbers.sort()
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])[: len(numbers)])
    counts, numbers = np.diff(np.append(first, len(numbers))), numbers[first]
    gram, text = np.divmod(numbers, len(texts))
    gram = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])[: len(gram)])
    return gram, text, counts


def _shared(gram: np.ndarray, text: np.ndarray, count: np.ndarray, held: int, total: np.ndarray, needed: np.ndarray, spare: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a text below held and one from there on that may share needed of the first one's q-grams.

    A text's q-grams are put in order of how many of the others have them, and of the most frequent ones are left out as many
    as come to no more than what it must share, less a spare part of it. A pair that shares enough must then share what is
    left of it among the others, which is looked up.
    """
    n = int(gram[-1]) + 1 if len(gram) else 0
    stop = np.cumsum(np.bincount(gram, minlength=n))
    first = stop - np.bincount(gram, minlength=n)
    low = first + np.bincount(gram[text < held], minlength=n)
    met = np.flatnonzero(text < held)
    met = met[stop[gram[met]] > low[gram[met]]]
    # texts with less than they need among all that meets are done
    most = np.bincount(text[met], count[met], held).astype(np.int64)
    met = met[(most >= needed)[text[met]]]
    if not len(met):
        return
    size = stop[gram[met]] - low[gram[met]]
    order = np.lexsort((size, text[met]))
    met, size = met[order], size[order]
    begins = np.searchsorted(text[met], np.arange(held + 1))
    upto = np.concatenate([[0], np.cumsum(count[met])])
    from_here = upto[begins[text[met] + 1]] - upto[:-1]  # what the text has from this q-gram on
    room = needed - np.maximum(1, np.ceil(needed * spare)).astype(np.int64)
    kept = from_here > room[text[met]]
    beyond = np.bincount(text[met][~kept], count[met][~kept], held).astype(np.int64)
    least, met, size = needed - beyond, met[kept], size[kept]
    begins, others = np.searchsorted(text[met], np.arange(held + 1)), len(total) - held
    step = max(1, CELLS // max(1, others))
    for k in range(0, held, step):
        a, b = begins[k], begins[min(k + step, held)]
        sums, upto = np.zeros(min(step, held - k) * others, np.int64), np.cumsum(size[a:b])
        for c in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            d = min(c + PAIRS, int(upto[-1]))
            rows = np.arange(np.searchsorted(upto, c, "right"), np.searchsorted(upto, d - 1, "right") + 1)
            begin, end = np.maximum(upto[rows] - size[a + rows], c), np.minimum(upto[rows], d)
            mine = met[a + rows]
            # the place of a row's first partner, less what lies before the row
            shift = low[gram[mine]] - (upto[rows] - size[a + rows])
            other = np.repeat(shift, end - begin) + np.arange(c, d)
            sums += np.bincount(np.repeat((text[mine] - k) * others - held, end - begin) + text[other], np.minimum(np.repeat(count[mine], end - begin), count[other]), len(sums)).astype(np.int64)
        small, large = np.divmod(np.flatnonzero(sums), max(1, others))
        enough = sums[small * others + large] >= least[small + k]
        yield small[enough] + k, large[enough] + held


def _similar(left: list[str], right: list[str], q: int, least: float, same: bool, spare: float) -> Iterator[tuple[int, int, int, int]]:
    """Number in left, number in right, common, of: similar pairs of texts, of which those in left have no more q-grams. same: both are one block, in order."""
    gram, text, count = _grams(left + right, q)
    held = len(left)
    total = np.array([len(t) - q + 1 for t in left + right], np.int64)
    needed = np.ceil(total[:held] * least - 1e-9).astype(np.int64)
    own = np.argsort(text, kind="stable")
    begins = np.searchsorted(text[own], np.arange(len(total) + 1))
    own_gram, own_count = gram[own], count[own]
    mark = np.zeros(int(gram[-1]) + 1 if len(gram) else 0, np.int64)
    for small, large in _shared(gram, text, count, held, total, needed, spare):
        if same:
            ahead = small < large - held
            small, large = small[ahead], large[ahead]
        new = np.flatnonzero(np.concatenate([[True], small[1:] != small[:-1]])[: len(small)])
        for a, b in zip(new.tolist(), np.append(new[1:], len(small)).tolist()):
            x = int(small[a])
            mine = slice(begins[x], begins[x + 1])
            mark[own_gram[mine]] = own_count[mine]
            for y in large[a:b].tolist():
                theirs = slice(begins[y], begins[y + 1])
                common = int(np.minimum(mark[own_gram[theirs]], own_count[theirs]).sum())
                if common >= total[x] * least - 1e-9:
                    yield x, y - held, common, int(total[x])
            mark[own_gram[mine]] = 0


def similar(texts: DataFrame, text: str, q: int, key: str, least: float, spare: float = 0.25) -> DataFrame:
    """texts: key, text, each of q letters or more. one, other, common, of: pairs that share least of the q-grams of the one that has fewer, of."""
    ship(texts.sparkSession)
    kind = dict(texts.dtypes)[key]
    sized = texts.select(F.col(key).alias("id"), F.col(text).alias("text"), F.length(text).cast("long").alias("size"))
    placed = stored(global_starts(sized, "size", "size"), "placed")
    letters = placed.agg(F.sum("size")).first()[0] or 0
    each = min(LETTERS, max(FEWEST, -(-letters // BLOCKS)))
    n = letters // each + 1
    rows = placed.groupBy(F.floor(F.col("start") / each).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("size", "id", "text"))).alias("held"))
    blocks = stored(rows, "blocks")  # rows of LETTERS and a text at most

    def side(name: str) -> DataFrame:
        return blocks.select(F.col("block").alias(f"{name}_block"), F.col("held.id").alias(f"{name}_ids"), F.col("held.text").alias(f"{name}_texts")).repartitionById(n, f"{name}_block")

    # each task reads the two rows where they were written; none is sent more than once
    met = side("left").join(side("right").hint("shuffle_replicate_nl"), F.col("left_block") <= F.col("right_block"))
    schema = pa.schema([("one", pa.string() if kind == "string" else pa.int64()), ("other", pa.string() if kind == "string" else pa.int64()), ("common", pa.int64()), ("of", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a, left_ids, left, b, right_ids, right = (c[i].as_py() for c in batch.columns)
                out = [(left_ids[x], right_ids[y], common, of) for x, y, common, of in _similar(left, right, q, least, a == b, spare)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    kind = kind if kind == "string" else "long"
    return met.mapInArrow(run, f"one {kind}, other {kind}, common long, of long")
