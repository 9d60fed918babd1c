"""Repeat families planted in texts, with the truth about where each copy stands.

Everything follows from the seed and md5, so a run can be repeated, here or in SQL. A text is cut into slots; each slot
gets a copy of one family's motif at a place within it, spread over every period-th letter, with up to most letters changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX, LETTERS, CHANGED = "0123456789abcdef", "ACGT" * 4, "CGTA"


def _number(*parts) -> Column:
    """From 0 to 2 ** 32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def motif(family: Column, size: int, seed: str) -> Column:
    """size letters (64 at most) of a family."""
    digits = F.concat(*(F.md5(F.concat_ws("-", F.lit(seed), F.lit(f"motif{i}"), family).cast("binary")) for i in range(2)))
    return F.translate(F.substring(digits, 1, size), HEX, LETTERS)


def copies(df: DataFrame, text: str, key: str, families: int, size: int, every: int, period: int = 1, most: int = 0, seed: str = "plant-1") -> DataFrame:
    """key, slot, pos, family, n_mut, copy: the truth. every: letters of a slot; texts have as many slots as fit, null ones none.

    A copy takes (size - 1) * period + 1 letters, which must be fewer than every. Of copy c's changed letters, n_mut in
    number (up to most), each stands in a stretch of the motif of its own.
    """
    span = (size - 1) * period + 1
    if span >= every:
        raise ValueError("a copy must be shorter than its slot")
    slots = df.select(key, F.explode(F.sequence(F.lit(0), F.floor(F.length(text) / every).cast("int") - 1)).alias("slot"), F.length(text).alias("n")).where(f"n >= {every}").drop("n")
    name = F.col(key).cast("string")
    placed = slots.select(key, "slot", (F.col("slot") * every + _number(seed, "at", name, F.col("slot").cast("string")) % (every - span)).alias("pos"), (_number(seed, "family", name, F.col("slot").cast("string")) % families).alias("family"), (_number(seed, "changes", name, F.col("slot").cast("string")) % (most + 1)).cast("int").alias("n_mut"))
    out = motif(F.col("family").cast("string"), size, seed)
    stretch = size // max(1, most)
    for i in range(most):
        at = (_number(seed, f"change{i}", name, F.col("slot").cast("string")) % stretch + i * stretch + 1).cast("int")
        out = F.when(F.col("n_mut") > i, F.overlay(out, F.translate(F.substring(out, at, F.lit(1)), "ACGT", CHANGED), at, F.lit(1))).otherwise(out)
    return placed.withColumn("copy", out)


def plant(df: DataFrame, text: str, key: str, truth: DataFrame, every: int, period: int = 1) -> DataFrame:
    """key, text: the texts with all copies of the truth in them. A text's slots are put together again in order."""
    cut = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{every}}}"), F.lit(0))).alias("slot", "piece"))
    own = truth.select(F.col(key).alias("plant_key"), F.col("slot").alias("plant_slot"), (F.col("pos") - F.col("slot") * every).cast("int").alias("off"), "copy")
    met = cut.join(own, (F.col(key) == F.col("plant_key")) & (F.col("slot") == F.col("plant_slot")), "left")
    span = (F.length("copy") - 1) * period + 1
    if period == 1:
        body = F.col("copy")
    else:  # letters of the copy, each followed by period - 1 letters of the text
        between = F.transform(F.sequence(F.lit(1), F.length("copy")), lambda i: F.concat(F.substring("copy", i, F.lit(1)), F.when(i < F.length("copy"), F.substring("piece", F.col("off") + (i - 1) * period + 2, F.lit(period - 1))).otherwise(F.lit(""))))
        body = F.array_join(between, "")
    planted = F.when(F.col("copy").isNull(), F.col("piece")).otherwise(F.concat(F.left("piece", F.col("off")), body, F.substring("piece", F.col("off") + span + 1, F.lit(every))))
    joined = met.select(key, F.struct("slot", planted.alias("piece")).alias("bit")).groupBy(key).agg(F.array_sort(F.collect_list("bit")).alias("bits"))  # one text
    whole = joined.select(F.col(key).alias("plant_key"), F.array_join(F.transform("bits", lambda b: b["piece"]), "").alias("planted_text"))
    return df.select(key, text).join(whole, F.col(key) == F.col("plant_key"), "left").select(key, F.coalesce("planted_text", F.col(text)).alias(text))
