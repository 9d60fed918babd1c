"""Suffix order, transforms, occurrence and common-prefix tables of many texts, however long each is.

Suffixes are ordered within a scope: each text's own (the key), or all texts of a collection. No text or scope is
gathered in one task: rows are dealt by ranges, and what lies before a range comes from a row per range. Only texts of up to
short.WITHIN characters are ordered where they are read, if each has an order of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.sources.code import ship
from strandline.sources.tables import stored

from . import short
from .grams import CHUNK, chunks, windows
from .streams import counter

HEAD, FOLD, PAD = 24, 4, "\x00"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with size: the sum of the sizes before each row of the range, and the range's number."""
    total, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("size")).to_numpy()
        before = total + np.cumsum(sizes) - sizes
        total += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(np.full(len(sizes), part, np.int32))], names=[*batch.schema.names, "before", "part"])


def _ranked(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, size, first: of each distinct key how many rows have it and how many have a smaller one. A written table.

    Equal keys are summed up before they are dealt by ranges, so a key is one row however many rows have it.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("size"))
    dealt = counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema)
    summed = stored(dealt.mapInArrow(_running, f"{kinds}, before long, part int"), label)
    parts = summed.groupBy("part").agg(F.sum("size").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("shift"))  # a row per range
    return summed.join(F.broadcast(shifts), "part").select(*keys, "size", (F.col("before") + F.col("shift")).alias("first"))


def _heads(df: DataFrame, text: str, key: str, scope: str | None, period: int, head: int, cyclic: bool = False) -> DataFrame:
    """scope, id, pos, gram: each suffix's first head characters, period apart (fewer where the text ends). cyclic: those of each rotation."""
    span = (head - 1) * period + 1
    if cyclic:
        round_ = F.expr(f"left(repeat({text}, cast(ceil({span} / length({text})) as int)), {span - 1})")
        rows = df.where(F.length(text) > 0).select(F.lit(0).alias("scope") if scope is None else F.col(scope).alias("scope"), F.col(key).alias("id"), F.concat(F.col(text), round_).alias("padded"))
        return windows(rows, "padded", span, "scope", "id").select("scope", "id", "pos", seq.spaced(F.col("gram"), period).alias("gram"))
    padded = df.where(F.length(text) > 0).select(F.lit(0).alias("scope") if scope is None else F.col(scope).alias("scope"), F.col(key).alias("id"), F.concat(F.col(text), F.lit(PAD * (span - 1))).alias("padded"))
    every = windows(padded, "padded", span, "scope", "id")
    return every.select("scope", "id", "pos", F.rtrim(seq.spaced(F.col("gram"), period), F.lit(PAD)).alias("gram"))


def names(df: DataFrame, text: str, key: str, scope: str | None, period: int = 1, head: int = HEAD, levels: list[tuple[int, DataFrame]] | None = None, cyclic: bool = False) -> DataFrame:
    """scope, id, pos, name, size: names order the suffixes of all scopes, scope by scope; size suffixes have the same name, as they are equal.

    A name is how many suffixes are smaller. Prefix doubling, by FOLD at a time: at first by the first head characters.
    Then, round by round, the suffixes of a name are ordered by the names of those that start where the characters
    known so far end, and move on within the room of their name. Suffixes that are alone with their name are done.
    What is dealt by ranges are distinct keys; the rows get their name by a join on the key, in which a crowded key is split.

    levels: gets (depth, table of id, pos, name) of the suffixes that share their first depth characters with others.
    cyclic: rotations instead of suffixes (with a period of 1): places go on at the text's start, until as many characters
    as the text has are known.
    """
    ship(df.sparkSession)
    heads = stored(_heads(df, text, key, scope, period, head, cyclic), "heads")
    sizes = stored(df.select(F.col(key).alias("id"), F.length(text).cast("long").alias("n")), "lengths") if cyclic else None
    found = _ranked(heads, ["scope", "gram"], "names")
    named = stored(heads.join(stored(found, "first-names"), ["scope", "gram"]).select("scope", "id", "pos", F.col("first").alias("name"), "size"), "names")
    nexts, depth = [f"next{i}" for i in range(1, FOLD)], head
    done, active = named.where("size = 1"), named.where("size > 1")
    if cyclic:
        known = active.join(sizes, "id").select(*active.columns, (F.col("n") > depth).alias("open"))
        done, active = done.unionByName(known.where("not open").drop("open")), known.where("open").drop("open")
    while not active.isEmpty():
        if levels is not None:
            levels.append((depth, active.select("id", "pos", "name")))
        # the few that are still open ask for the names further on, so that only they need to move
        asked = active.select("id", "pos", F.explode(F.array(*map(F.lit, range(1, FOLD)))).alias("step")).withColumn("at", F.col("pos") + F.col("step") * depth * period)
        if cyclic:
            asked = asked.join(sizes, "id").withColumn("at", F.col("at") % F.col("n")).drop("n")
        every = done.unionByName(active).select(F.col("id").alias("of"), F.col("pos").alias("there"), F.col("name").alias("further"))
        reached = asked.join(every, (F.col("id") == F.col("of")) & (F.col("at") == F.col("there"))).groupBy("id", "pos").agg(*(F.max(F.when(F.col("step") == i, F.col("further"))).alias(n) for i, n in enumerate(nexts, 1)))
        both = stored(active.drop("size").join(reached, ["id", "pos"], "left").withColumns({n: F.coalesce(n, F.lit(-1)) for n in nexts}), "asked")
        ranked = stored(_ranked(both, ["name", *nexts], "names"), "refined")
        opening = stored(ranked.groupBy("name").agg(F.min("first").alias("opens")), "openings")
        placed = stored(ranked.join(opening, "name").withColumn("new", F.col("name") + F.col("first") - F.col("opens")).drop("first", "opens"), "moved")
        moved = stored(both.join(placed, ["name", *nexts]).select("scope", "id", "pos", F.col("new").alias("name"), "size", F.col(nexts[-1]).alias("beyond")), "names")
        if cyclic:
            moved = moved.join(sizes, "id").withColumn("beyond", F.when(F.col("n") > depth * FOLD, 0).otherwise(-1)).drop("n")
        # equal suffixes that end within the characters known can't be told apart
        done = done.unionByName(moved.where("size = 1 or beyond < 0").drop("beyond"))
        if levels is not None:
            ended = moved.where("size > 1 and beyond < 0").select("id", "pos", "name")
            levels.append((depth * FOLD, ended))
        active = moved.where("size > 1 and beyond >= 0").drop("beyond")
        depth *= FOLD
    return done


def ordered(df: DataFrame, text: str, key: str, scope: str | None, period: int = 1, levels: list[tuple[int, DataFrame]] | None = None, cyclic: bool = False) -> DataFrame:
    """scope, id, pos, rank: suffixes of each scope in the order of every period-th character of theirs; ties by id and position. levels, cyclic: see names()."""
    if scope != key or levels is not None:
        return _ordered(df, text, key, scope, period, levels, cyclic)
    near, far = short.split(df, text)
    each = short.table(near, text, key, period, cyclic).select(F.col(key).alias("scope"), F.col(key).alias("id"), "pos", "rank")
    return each if far is None else each.unionByName(_ordered(far, text, key, scope, period, levels, cyclic))


def _ordered(df: DataFrame, text: str, key: str, scope: str | None, period: int, levels: list[tuple[int, DataFrame]] | None = None, cyclic: bool = False) -> DataFrame:
    """ordered() over ranges, however long the texts are."""
    found = stored(names(df, text, key, scope, period, levels=levels, cyclic=cyclic), "named")
    # equal suffixes are numbered in one order of them all, of which each name has a stretch
    tied = stored(counter(found.where("size > 1"), "name", "id", "pos", name="place"), "tied")
    opening = stored(tied.groupBy("name").agg(F.min("place").alias("opens")), "openings")
    apart = tied.join(opening, "name").select("scope", "id", "pos", (F.col("name") + F.col("place") - F.col("opens")).alias("place"))
    placed = stored(found.where("size = 1").select("scope", "id", "pos", F.col("name").alias("place")).unionByName(apart), "places")
    starts = stored(placed.groupBy("scope").agg(F.min("place").alias("opens")), "scopes")
    return placed.join(starts, "scope").select("scope", "id", "pos", (F.col("place") - F.col("opens")).alias("rank"))


def suffix_array(df: DataFrame, text: str, key: str, period: int = 1) -> DataFrame:
    """key, rank, pos: suffixes of each text in the order of every period-th character of theirs; ties by position."""
    return ordered(df, text, key, key, period).select(F.col("scope").alias(key), "rank", "pos")


def transformed(df: DataFrame, text: str, key: str, period: int = 1, counts: bool = False) -> DataFrame:
    """suffix_array() with bwt, as transform() adds it; counts: and with what occurrences() adds."""
    near, far = short.split(df, text)
    each = short.table(near, text, key, period, counts=counts).withColumnRenamed("before", "bwt")
    if far is None:
        return each
    order = _ordered(far, text, key, key, period).select(F.col("scope").alias(key), "rank", "pos")
    table = transform(far, order, text, key, period)
    return each.unionByName(occurrences(table, key) if counts else table)


def prefixed(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, rank, pos, lcp: the suffixes of each text in order, with what each shares with the one before (0 for the first)."""
    near, far = short.split(df, text)
    each = short.table(near, text, key, prefixes=True).drop("before")
    return each if far is None else each.unionByName(_prefixed(far, text, key))


def _prefixed(df: DataFrame, text: str, key: str) -> DataFrame:
    levels: list[tuple[int, DataFrame]] = []
    order = _ordered(df, text, key, key, 1, levels).select(F.col("scope").alias(key), "rank", "pos")
    return common_prefixes(df, order, text, key, levels=levels)


def rotations(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, rank, pos, last: each text's rotations in order, by where they start, with their last character (the transform); equal ones by position."""
    near, df = short.split(df, text)
    each = short.table(near, text, key, cyclic=True).withColumnRenamed("before", "last")
    if df is None:
        return each
    order = _ordered(df, text, key, key, 1, cyclic=True)
    sizes = stored(df.select(F.col(key).alias("sized"), F.length(text).cast("long").alias("n")), "lengths")
    ends = order.join(sizes, F.col("id") == F.col("sized")).select("id", "pos", "rank", F.pmod(F.col("pos") - 1, F.col("n")).alias("end"))
    chars = windows(df, text, 1, key).select(F.col(key).alias("of"), F.col("pos").alias("at"), F.col("gram").alias("last"))
    return each.unionByName(ends.join(chars, (F.col("id") == F.col("of")) & (F.col("end") == F.col("at"))).select(F.col("id").alias(key), "rank", "pos", "last"))


def collection_array(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, pos, rank: suffixes of all texts together; ties by key and position."""
    return ordered(df, text, key, None).select(F.col("id").alias(key), "pos", "rank")


def limited_order(df: DataFrame, text: str, key: str, length: int, period: int = 1) -> DataFrame:
    """key, rank, pos: suffixes of each text by their first length characters (period apart) alone; ties by position."""
    near, df = short.split(df, text)
    each = short.table(near, text, key, period, limit=length).select(key, "rank", "pos")
    if df is None:
        return each
    heads = _heads(df, text, key, key, period, length)
    placed = stored(heads.repartitionByRange("scope", "gram", "pos").sortWithinPartitions("scope", "gram", "pos").withColumn("row", F.monotonically_increasing_id()), "limited")
    parts = placed.groupBy("scope", F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("scope", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return each.unionByName(placed.withColumn("part", F.shiftright("row", 33)).join(shifts, ["scope", "part"]).select(F.col("scope").alias(key), (F.col("row") + F.col("shift")).alias("rank"), "pos"))


def blocks(df: DataFrame, text: str, key: str, length: int, period: int = 1) -> DataFrame:
    """key, head, first, last: the ranks of the suffixes that start with each head of length characters (period apart; fewer at a text's end).

    Suffixes of one head follow one another in the order, so how many have each smaller head is enough.
    """
    heads = _heads(df, text, key, key, period, length).groupBy(F.col("scope").alias(key), F.col("gram").alias("head")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("head"))  # a row per head
    return heads.select(key, "head", (upto - F.col("n")).alias("first"), (upto - 1).alias("last"))


def transform(df: DataFrame, order: DataFrame, text: str, key: str, period: int = 1) -> DataFrame:
    """order with bwt: the character period places before each suffix, $ where there is none."""
    chars = windows(df, text, 1, key).select(key, (F.col("pos") + period).alias("pos"), F.col("gram").alias("bwt"))
    return order.join(chars, [key, "pos"], "left").select(key, "rank", "pos", F.coalesce("bwt", F.lit("$")).alias("bwt"))


def occurrences(transformed: DataFrame, key: str) -> DataFrame:
    """transformed with occ_a, occ_c, occ_g, occ_t: how often each letter stands in bwt up to and with this rank."""
    names_ = {b: f"occ_{b.lower()}" for b in seq.BASES}
    dealt = stored(transformed.repartitionByRange(key, "rank").withColumn("occ_part", F.spark_partition_id()), "occurrences")
    sums = dealt.groupBy(key, "occ_part").agg(*(F.count_if(F.col("bwt") == b).alias(b) for b in names_))
    before = Window.partitionBy(key).orderBy("occ_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(key, "occ_part", *(F.coalesce(F.sum(b).over(before), F.lit(0)).alias(f"before_{b}") for b in names_))
    upto = Window.partitionBy(key, "occ_part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # the part of one range
    inner = dealt.select("*", *(F.sum((F.col("bwt") == b).cast("long")).over(upto).alias(n) for b, n in names_.items()))
    return inner.join(shifts, [key, "occ_part"]).select(*transformed.columns, *((F.col(n) + F.col(f"before_{b}")).alias(n) for b, n in names_.items()))


def first_column(df: DataFrame, text: str, key: str, period: int = 1) -> DataFrame:
    """key, letter, first: ranks before the block of suffixes that start with the letter, counted as the transform's letters are.

    The transform holds every letter but the last period ones, so no suffix order is needed.
    """
    counted = F.expr(f"left({text}, greatest(0, length({text}) - {period}))")
    letters = df.where(F.length(text) > 0).select(key, *((F.length(counted) - F.length(F.translate(counted, b, ""))).cast("long").alias(b) for b in seq.BASES))
    rows, before = [], F.lit(0).cast("long")
    for b in seq.BASES:
        rows.append(F.struct(F.lit(b).alias("letter"), before.alias("first")))
        before = before + F.col(b)
    return letters.select(key, F.inline(F.array(*rows)))


def common_prefixes(df: DataFrame, order: DataFrame, text: str, key: str, scope: str | None = None, levels: list[tuple[int, DataFrame]] | None = None) -> DataFrame:
    """order (key, pos, rank, and scope where it isn't the key) with lcp: characters shared with the suffix of the rank before in its scope (0 for the first).

    levels: as names() fills them for the scope (computed if not given). Neighbours whose names are equal at a depth
    share so many characters and go on from there: from the deepest level down, each asked FOLD - 1 times, then by the
    last HEAD characters themselves. The rounds grow with the logarithm of the longest copy.
    """
    if levels is None:
        levels = []
        names(df, text, key, None if scope == "" else scope or key, levels=levels)
    by = F.lit(0) if scope == "" else F.col(scope or key)
    rows = stored(order.select(by.alias("scope"), F.col(key).alias("id"), "pos", "rank"), "order")
    before = rows.select("scope", (F.col("rank") + 1).alias("rank"), F.col("id").alias("other"), F.col("pos").alias("other_pos"))
    both = rows.join(before, ["scope", "rank"]).withColumn("off", F.lit(0).cast("long"))
    tables: dict[int, DataFrame] = {}
    for depth, table in levels:
        tables[depth] = tables[depth].unionByName(table) if depth in tables else table
    depths = sorted(tables, reverse=True)
    columns = ["scope", "id", "pos", "rank", "other", "other_pos", "off"]
    alone = None
    if depths:  # those that differ in the first HEAD characters needn't be asked for more
        both = stored(_same_name(both, tables[depths[-1]]), "pairs")
        alone, both = both.where("not same").select(*columns), both.where("same").select(*columns)
    for depth in depths:
        for _ in range(FOLD - 1):
            both = stored(_same_name(both, tables[depth]).withColumn("off", F.when(F.col("same"), F.col("off") + depth).otherwise(F.col("off"))).select(*columns), "pairs")
    open_ = both if alone is None else alone.unionByName(both)
    held = chunks(df, text, HEAD - 1, key).select(F.col(key).alias("held"), "chunk_no", "piece").hint("merge")
    sizes = df.select(F.col(key).alias("sized"), F.length(text).cast("long").alias("n")).hint("merge")

    def site(at: Column) -> Column:
        return F.coalesce(F.substring("piece", (at % CHUNK).cast("int") + 1, F.lit(HEAD)), F.lit(""))

    at, other_at = F.col("pos") + F.col("off"), F.col("other_pos") + F.col("off")
    mine = open_.join(held, (F.col("id") == F.col("held")) & (F.floor(at / CHUNK).cast("int") == F.col("chunk_no")), "left").select(*columns, site(at).alias("s"))
    compared = mine.join(held, (F.col("other") == F.col("held")) & (F.floor(other_at / CHUNK).cast("int") == F.col("chunk_no")), "left").select(*columns, seq.common_prefix(F.col("s"), site(other_at)).alias("more"))
    # equal names of suffixes that end count as their whole depth
    ends = compared.join(sizes, F.col("id") == F.col("sized"))
    found = ends.select("scope", "id", "pos", "rank", F.least(F.col("off") + F.col("more"), F.col("n") - F.col("pos")).alias("lcp"))
    found = rows.where("rank = 0").select("scope", "id", "pos", "rank", F.lit(0).cast("long").alias("lcp")).unionByName(found)
    return found.select(*([] if scope in (None, "") else [F.col("scope").alias(scope)]), F.col("id").alias(key), "rank", "pos", "lcp")


def _same_name(pairs: DataFrame, level: DataFrame) -> DataFrame:
    """pairs (id, pos, other, other_pos, off and others) with same: whether both suffixes, off characters on, have one name at the level."""
    mine = level.select(F.col("id").alias("n_id"), F.col("pos").alias("n_pos"), F.col("name").alias("mine"))
    theirs = level.select(F.col("id").alias("o_id"), F.col("pos").alias("o_pos"), F.col("name").alias("theirs"))
    joined = pairs.join(mine, (F.col("id") == F.col("n_id")) & (F.col("pos") + F.col("off") == F.col("n_pos")), "left").join(theirs, (F.col("other") == F.col("o_id")) & (F.col("other_pos") + F.col("off") == F.col("o_pos")), "left")
    return joined.withColumn("same", F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False))).drop("n_id", "n_pos", "o_id", "o_pos", "mine", "theirs")
