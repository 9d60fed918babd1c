"""Mixing sources to target weights by systematic sampling.

Every row of a source has the same expected number of copies, target / source_size. Rows are ordered within their
source by size, then doc_id and text hash, and their expected copies are summed up; with one fixed offset for the
source added, a row is emitted once per integer that its stretch of the sum crosses. Ordering by size makes the sample
stratified, so the words taken miss the target by about one large document.

Edge cases: null text has size 0; a null source is a source of its own, last in order; rows of size 0 may be emitted
but add no words; a source without words has target 0 and nothing of it is taken; equal rows are told apart only by
their place; very long texts only count as large; an empty table gives an empty result. All columns of documents are
carried along in a struct, so names can't clash. Targets are planned over one row per source, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SHARE, CAP, WEIGHTS, SEED = 1.5, 2.0, (3, 1, 2), "mix-1"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: a row (source, source_size) per source. Adds target: the weighted shares of share * all words, none above cap * its source's words.

    Resharing the excess by weight until none is above ends at targets min(level * weight, cap * size); the level is
    that of the first source, by cap / weight, that doesn't reach its cap.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double")).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_need = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everywhere = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighted.withColumn("level", level)
    common = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everywhere)
    return leveled.withColumn("common", common["level"]).select("source", "source_size", F.coalesce(F.least(F.col("common") * F.col("weight"), F.col("most")), F.col("most")).alias("target"))


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """docs: doc_id, text, source and any other columns. doc (a struct of them all), source, mix_size, mix_source_size, mix_target, mix_copies."""
    sized = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", words(F.col("text")).alias("mix_size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("mix_tie"))
    return _placed(sized, share, cap, weights, seed).drop("mix_tie", "doc_id")


def mix_sizes(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The same decisions over doc_id and source alone: texts stay behind."""
    thin = docs.select("doc_id", "source", words(F.col("text")).alias("mix_size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("mix_tie"))
    return _placed(thin, share, cap, weights, seed).drop("mix_tie")


def _offset(seed: str, source: Column) -> Column:
    """From 0 to 1, fixed by the seed and the source, so reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _placed(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...], seed: str) -> DataFrame:
    """The running sum over a range-partitioned, written table: the place in a part comes from the row id, what lies
    before from the sums per (source, part), of which there are as many as parts and sources together; they are written, so
    that their size says whether they are sent to all tasks or joined."""
    keys = [F.col("source").asc_nulls_last(), "mix_size", "doc_id", "mix_tie"]
    ordered = stored(sized.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mix_row", F.monotonically_increasing_id()), "mix")
    part = F.shiftright("mix_row", 33)
    parts = ordered.groupBy("source", part.alias("part")).agg(F.count("*").alias("n"), F.min("mix_row").alias("first"), F.sum("mix_size").alias("size"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select("source", "part", (before - F.col("first")).alias("shift"), "size")
    planned = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    small = placed.alias("p").join(planned.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.source").alias("mix_source"), F.col("part").alias("mix_part"), F.col("shift").alias("mix_shift"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("mix_rate"),
        _offset(seed, F.col("p.source")).alias("mix_offset"))
    joined = ordered.join(stored(small, "mix-parts"), F.col("source").eqNullSafe(F.col("mix_source")) & (part == F.col("mix_part")))
    rank = F.col("mix_row") + F.col("mix_shift")
    crossed = F.floor(F.col("mix_offset") + (rank + 1) * F.col("mix_rate")) - F.floor(F.col("mix_offset") + rank * F.col("mix_rate"))
    return joined.withColumn("mix_copies", crossed).drop("mix_source", "mix_part", "mix_shift", "mix_rate", "mix_offset", "mix_row")


def emitted(mixed: DataFrame) -> DataFrame:
    """The documents of mix(), with their own columns, every row as often as it is taken."""
    return mixed.where("mix_copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy")).select("doc.*")
