"""Ordered dataflow operators. A stream is a DataFrame with keys that order it; ordinals are dense and start at 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.tables import stored


def counter(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """Appends the ordinal in the given order, without gathering the rows in one task.

    Rows are range-partitioned and sorted, and the table written; an ordinal is the rows in the parts before, of which
    there are as many counts as parts, and the place in the part.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("stream_row", F.monotonically_increasing_id()), "counter")
    part = F.shiftright("stream_row", 33)
    parts = placed.groupBy(part.alias("stream_part")).agg(F.count("*").alias("n"), F.min("stream_row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stream_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("stream_part", (before - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(shifts), part == F.col("stream_part")).withColumn(name, F.col("stream_row") + F.col("shift")).drop("stream_row", "stream_part", "shift")


def global_starts(df: DataFrame, length: str, key: str, name: str = "start") -> DataFrame:
    """Appends where each text starts in the concatenation of all, in key order: sums before the part, then in the part."""
    placed = stored(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("stream_part", F.spark_partition_id()), "starts")
    parts = placed.groupBy("stream_part").agg(F.sum(length).alias("n"))
    before = parts.select("stream_part", F.coalesce(F.sum("n").over(Window.orderBy("stream_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    inner = Window.partitionBy("stream_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(before), "stream_part").withColumn(name, (F.col("shift") + F.coalesce(F.sum(length).over(inner), F.lit(0))).cast("long")).drop("stream_part", "shift")


def cut_runs(df: DataFrame, length: str, order: str, bases: int, runs: int) -> DataFrame:
    """The rows in order until bases in all, or so many runs, are reached; the run that reaches the bases is cut."""
    # what lies behind the first so many runs has no part in any result, so only those are numbered
    some = df.orderBy(order).limit(runs) if runs <= BLOCK else df
    placed = counter(global_starts(some, length, order, "cut_start"), order, name="cut_ord")
    left = placed.where((F.col("cut_start") < bases) & (F.col("cut_ord") < runs))
    return left.withColumn(length, F.least(F.col(length), bases - F.col("cut_start"))).drop("cut_start", "cut_ord")


def localized(df: DataFrame, key: str, length: str, start: str = "start") -> DataFrame:
    """pos, key, off: each position of the concatenation as a text and a place in it."""
    return df.where(F.col(length) > 0).select(key, start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(length) - 1)).alias("off")).select((F.col(start) + F.col("off")).alias("pos"), key, "off")


def namer(df: DataFrame, *keys: str, name: str = "name_id") -> DataFrame:
    """Appends the dense id, from 0, of the keys' sorted distinct values."""
    ids = counter(df.select(*keys).distinct(), *keys, name=name)
    return df.join(ids, list(keys))


def joiner(*streams: DataFrame, on: str = "ord") -> DataFrame:
    """Positional zip of two streams or more: as long as the shortest."""
    out = streams[0]
    for other in streams[1:]:
        out = out.join(other, on)
    return out


BLOCK = 1 << 16


def _beside(df: DataFrame, group: list[str], order: list[str], before: int, after: int, columns: dict[str, Callable[[Callable[[Column, int], Column]], Column]]) -> DataFrame:
    """df with columns made of rows up to before places before and after places behind each row in its group.

    All rows are numbered in the order of group and order and cut into blocks of BLOCK rows, whatever group they are of;
    rows near a block's edge also go to the blocks that look at them. So no group stands in one task as a whole.
    columns: name and a function of at(value, places), which is null outside the group.
    """
    numbered = counter(df, *group, *order, name="stream_ord")
    first, last = F.floor((F.col("stream_ord") - after) / BLOCK), F.floor((F.col("stream_ord") + before) / BLOCK)
    spread = numbered.withColumn("stream_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("stream_block").orderBy("stream_ord")

    def at(value: Column, places: int) -> Column:
        move = (lambda c: F.lead(c, places).over(w)) if places >= 0 else (lambda c: F.lag(c, -places).over(w))
        same = F.lit(True) if places == 0 else move(F.lit(True)).isNotNull()
        for g in group:
            same = same & (F.lit(True) if places == 0 else move(F.col(g)).eqNullSafe(F.col(g)))
        return F.when(same, value if places == 0 else move(value))

    made = spread.select("*", *(make(at).alias(name) for name, make in columns.items()))
    return made.where(F.col("stream_block") == F.floor(F.col("stream_ord") / BLOCK)).drop("stream_ord", "stream_block")


def placed(df: DataFrame, group: list[str], order: list[str], start: str = "from_start", end: str = "from_end") -> DataFrame:
    """Appends each row's place in its group, from 0, and how many rows are left with it, from 1.

    Places are differences to the group's first and last number. Those are joined, and a crowded group is split.
    """
    numbered = counter(df, *group, *order, name="stream_ord")
    edges = stored(numbered.groupBy(*(F.col(g).alias(f"stream_{g}") for g in group)).agg(F.min("stream_ord").alias("stream_first"), F.max("stream_ord").alias("stream_last")), "edges")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"stream_{g}"))
    joined = numbered.join(edges, same)
    return joined.select(*df.columns, (F.col("stream_ord") - F.col("stream_first")).alias(start), (F.col("stream_last") - F.col("stream_ord") + 1).alias(end))


def shifter(df: DataFrame, value: str, delta: int, group: list[str], order: list[str], blank=None, name: str = "shifted") -> DataFrame:
    """Appends the value delta places on (back, if negative) in its group, or the blank where there is no such row."""
    def make(at):
        return F.when(at(F.lit(True), delta), at(F.col(value), delta)).otherwise(F.lit(blank))

    return _beside(df, group, order, max(0, -delta), max(0, delta), {name: make})


def echoer(df: DataFrame, value: str, k: int, group: list[str], order: list[str], name: str = "echo") -> DataFrame:
    """Appends the array of the value and the k - 1 values before it, newest first; rows without so many are left out."""
    columns = {name: lambda at: F.array(*(at(F.col(value), -i) for i in range(k))), "echo_full": lambda at: at(F.lit(True), 1 - k)}
    return _beside(df, group, order, k - 1, 0, columns).where("echo_full").drop("echo_full")


def tupler(df: DataFrame, value: str, k: int, group: list[str], order: list[str], name: str = "tuple", keep_last: bool = False) -> DataFrame:
    """Appends the array of the value and the k - 1 values after it. keep_last: rows near the end stay, with blanks (nulls)."""
    columns = {name: lambda at: F.array(*(at(F.col(value), i) for i in range(k))), "tuple_full": lambda at: at(F.lit(True), k - 1)}
    out = _beside(df, group, order, 0, k - 1, columns)
    return (out if keep_last else out.where("tuple_full")).drop("tuple_full")


def sampler(df: DataFrame, value: str, m: int, cover: tuple[int, ...], group: list[str], order: list[str]) -> DataFrame:
    """m-tuples at the positions in a difference cover, counted from the end of the group."""
    counted = placed(df, group, order).drop("from_start")
    return tupler(counted, value, m, group, order, keep_last=True).where((F.col("from_end") % m).isin(*cover))


def mapper(df: DataFrame, place: Column, name: str = "ord") -> DataFrame:
    """Rows under new ordinals; place is a bijection of the old ones."""
    return df.withColumn(name, place)


def hamming_environment(df: DataFrame, text: str, alphabet: str, *keys: str) -> DataFrame:
    """keys, variant: the text and all its single substitutions."""
    swaps = df.select(*keys, text, F.explode(F.sequence(F.lit(1), F.length(text))).alias("at")).where(F.length(text) > 0).select(*keys, text, "at", F.explode(F.array(*map(F.lit, alphabet))).alias("letter"))
    changed = swaps.where(F.expr(f"substring({text}, at, 1)") != F.col("letter")).select(*keys, F.overlay(F.col(text), F.col("letter"), F.col("at"), F.lit(1)).alias("variant"))
    return df.select(*keys, F.col(text).alias("variant")).unionByName(changed)


#: Rows of a part whose variants are made distinct together.
SPREAD = 1 << 13


def edit_environment(df: DataFrame, text: str, alphabet: str, *keys: str) -> DataFrame:
    """keys, variant: distinct texts at edit distance 1 at most.

    Texts are dealt by key before they are spread, so that variants aren't shuffled and a task makes those of SPREAD texts or so.
    """
    df = df.select(*keys, text).repartition(1 + df.count() // SPREAD, *keys)
    inner = df.where(F.length(text) > 0).select(*keys, text, F.explode(F.sequence(F.lit(1), F.length(text))).alias("at"))
    fewer = inner.select(*keys, F.expr(f"concat(left({text}, at - 1), substring({text}, at + 1))").alias("variant"))
    gaps = df.select(*keys, text, F.explode(F.sequence(F.lit(0), F.length(text))).alias("at")).select(*keys, text, "at", F.explode(F.array(*map(F.lit, alphabet))).alias("letter"))
    more = gaps.select(*keys, F.expr(f"concat(left({text}, at), letter, substring({text}, at + 1))").alias("variant"))
    return hamming_environment(df, text, alphabet, *keys).unionByName(fewer).unionByName(more).distinct()
