"""The child table of a suffix order: how intervals of common prefixes hang together, from previous smaller values.

Ranks of a scope are dealt by ranges and scanned with a stack. What a range can't settle are rows with less in common
than all before them in it, at most as many as their common prefix is long; those, and the stack that the range leaves,
are settled scope by scope: a few rows for each range that a scope crosses.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.code import ship
from strandline.sources.tables import stored

from . import short, suffixes

SETTLED, OPEN, LEFT = 0, 1, 2


def before(prefixes: DataFrame, scope: str) -> DataFrame:
    """prefixes: scope, rank (from 0 in each scope), lcp. Adds before and before_lcp: the nearest rank before in the scope with as much in common or less; null for rank 0."""
    ship(prefixes.sparkSession)
    kind = dict(prefixes.dtypes)[scope]
    key = pa.string() if kind == "string" else pa.int64()
    fields = [("scope", key), *((n, pa.int64()) for n in ("rank", "lcp", "before", "before_lcp"))]
    schema, sent = pa.schema([*fields, ("kind", pa.int32()), ("part", pa.int32())]), 20_000

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, at, out = TaskContext.get().partitionId(), [], None, []
        for batch in batches:
            for name, rank, lcp in zip(*(c.to_pylist() for c in batch.columns)):
                if name != at:
                    out += [(at, r, v, None, None, LEFT, part) for r, v in stack]
                    at, stack, whole = name, [], rank == 0
                while stack and stack[-1][1] > lcp:
                    stack.pop()
                found = stack[-1] if stack else (None, None)
                out.append((name, rank, lcp, *found, SETTLED if stack or whole else OPEN, part))
                if stack and stack[-1][1] == lcp:
                    stack.pop()
                stack.append((rank, lcp))
                if len(out) >= sent:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        out += [(at, r, v, None, None, LEFT, part) for r, v in stack]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    settled = pa.schema(fields)

    def settle(group: pa.Table) -> pa.Table:
        """Open rows and left stacks of one scope."""
        out, ranks, values, part, mine = [], [], [], None, []
        rows = sorted(zip(*(group[n].to_pylist() for n in ("part", "kind", "rank", "lcp"))))
        scope_ = group["scope"][0].as_py()
        for p, what, rank, lcp in [*rows, (None, LEFT, None, None)]:
            if p != part and mine:  # a range's stack goes on top of what is smaller than all of it
                keep = bisect_right(values, mine[0][1] - 1)
                ranks, values = ranks[:keep] + [r for r, _ in mine], values[:keep] + [v for _, v in mine]
                mine = []
            part = p
            if p is None:
                break
            if what == OPEN:
                k = bisect_right(values, lcp) - 1
                out.append((scope_, rank, lcp, ranks[k], values[k]))
            else:
                mine.append((rank, lcp))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), settled)], schema=settled) if out else settled.empty_table()

    columns = f"scope {kind if kind == 'string' else 'long'}, rank long, lcp long, before long, before_lcp long"
    dealt = prefixes.select(F.col(scope).cast("string" if kind == "string" else "long").alias("scope"), F.col("rank").cast("long"), F.col("lcp").cast("long")).repartitionByRange("scope", "rank").sortWithinPartitions("scope", "rank")
    found = stored(dealt.mapInArrow(scan, columns + ", kind int, part int"), "scanned")
    crossing = stored(found.where(f"kind = {OPEN}").select(F.col("scope").alias("crossed")).distinct(), "crossing")
    late = found.where(f"kind <> {SETTLED}").join(crossing, F.col("scope") == F.col("crossed"), "left_semi").groupBy("scope").applyInArrow(settle, columns)
    names = ["scope", "rank", "lcp", "before", "before_lcp"]
    return found.where(f"kind = {SETTLED}").select(*names).unionByName(late).withColumnRenamed("scope", scope)


def child_table(prefixes: DataFrame, scope: str) -> DataFrame:
    """scope, rank, up, down, next_l (null where there is none). prefixes: scope, rank, lcp.

    next_l: the next rank with as much in common and more between. down: of the ranks behind, up to the first with as
    much or less in common, the first of those with the least. up: the same of the ranks between the last such before and this one.
    """
    rows = stored(before(prefixes, scope), "before")
    chain = Window.partitionBy(scope, "before").orderBy("rank")  # falling common prefixes: as many rows as the longest has letters
    up = F.when(F.col("before").isNotNull(), F.lag("rank").over(chain))
    more = F.col("lcp") > F.col("before_lcp")
    below = rows.where("before is not null").groupBy(F.col(scope).alias("of"), "before").agg(F.max(F.when(more, F.col("rank"))).alias("down"), F.max(F.when(~more, F.col("rank"))).alias("next_l"))
    below = stored(below.withColumnRenamed("before", "at"), "below")
    ups = rows.select(scope, "rank", up.alias("up"))
    return ups.join(below, (F.col(scope) == F.col("of")) & (F.col("rank") == F.col("at")), "left").select(scope, "rank", "up", "down", "next_l")


def children(df: DataFrame, text: str, key: str) -> DataFrame:
    """child_table() of the suffix order of each text."""
    near, far = short.split(df, text)
    names = ("up", "down", "next_l")
    each = short.table(near, text, key, links=True).select(key, "rank", *(F.when(F.col(n) >= 0, F.col(n)).alias(n) for n in names))
    return each if far is None else each.unionByName(child_table(suffixes.prefixed(far, text, key), key))
