"""Windows over texts, q-gram indexes, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.sources.tables import stored

from . import overlaps
from .streams import global_starts
from .tallies import gram_classes, tallied

CHUNK = 256


def chunks(df: DataFrame, text: str, overlap: int, *keys: str, size: int = CHUNK) -> DataFrame:
    """keys, chunk_no, piece: each text in chunks of size characters, with the next overlap characters behind each."""
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    behind = 1 + (overlap - 1) // size if overlap else 0
    lapped = F.transform("cut", lambda p, i: F.concat(p, F.left(F.concat(*(F.coalesce(F.get("cut", i + 1 + n), F.lit("")) for n in range(behind)), F.lit("")), F.lit(overlap))))
    return df.select(*keys, cut.alias("cut")).select(*keys, F.posexplode(lapped).alias("chunk_no", "piece"))


def windows(df: DataFrame, text: str, size: int, *keys: str) -> DataFrame:
    """keys, pos (from 0), gram: every window of size characters. Texts shorter than size have none.

    Substrings deep in a long text cost its length, so texts are cut into chunks with an overlap first.
    """
    chunk = max(CHUNK, size)
    pieces = chunks(df, text, size - 1, *keys, size=chunk).where(F.length("piece") >= size)
    last = F.least(F.length("piece") - size, F.lit(chunk - 1))
    each = pieces.select(*keys, "chunk_no", "piece", F.explode(F.sequence(F.lit(0), last)).alias("off"))
    return each.select(*keys, (F.col("chunk_no").cast("long") * chunk + F.col("off")).alias("pos"), F.expr(f"substring(piece, off + 1, {size})").alias("gram"))


def at_places(places: DataFrame, df: DataFrame, text: str, key: str, longest: int) -> DataFrame:
    """places (key, pos, size up to longest) with site: the size characters at pos; those that run out of the text are left out. Joined chunk by chunk."""
    # merged: Spark takes exploded chunks for as small as their texts, and would send them through the driver
    held = chunks(df, text, longest - 1, key).withColumnRenamed("chunk_no", "site_chunk")
    met = places.withColumn("site_chunk", F.floor(F.col("pos") / CHUNK).cast("int")).join(held.hint("merge"), [key, "site_chunk"])
    return met.withColumn("site", F.expr(f"substring(piece, cast(pos % {CHUNK} as int) + 1, size)")).where(F.length("site") == F.col("size")).drop("site_chunk", "piece")


def gram_counts(df: DataFrame, text: str, size: int, key: str) -> DataFrame:
    """gram, key, cnt."""
    return windows(df, text, size, key).groupBy("gram", key).agg(F.count("*").alias("cnt"))


def directory(df: DataFrame, text: str, size: int, key: str) -> DataFrame:
    """gram, cnt, first: counts over all texts and where each gram's block starts, by sums per range of grams."""
    total = windows(df, text, size, key).groupBy("gram").agg(F.count("*").alias("cnt"))
    return global_starts(total, "cnt", "gram", "first")


def classes(counts: DataFrame, key: str) -> DataFrame:
    """counts: gram, key, cnt. key, class (smallest key with the same grams and counts), total: a row per text that has grams."""
    prints = counts.groupBy(key).agg(F.sum("cnt").alias("total"), F.count("*").alias("grams"), F.bit_xor(F.xxhash64("gram", "cnt")).alias("one"), F.bit_xor(F.xxhash64(F.lit(7), "cnt", "gram")).alias("two"))
    alike = ["total", "grams", "one", "two"]
    return prints.join(prints.groupBy(*alike).agg(F.min(key).alias("class")), alike).select(key, "class", "total")


def similarity(df: DataFrame, text: str, size: int, key: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, sim) of classes of texts with a similarity of least (above 0) or more; the classes (key, class, total).

    Similarity is the sum of least counts of shared grams over the smaller text's total. Texts with equal counts are one
    class, of similarity 1 within. Blocks of the classes' texts meet (overlaps.py). No gram is left out.
    """
    groups = stored(gram_classes(df, text, size, key), "classes")
    heads = groups.where(F.col(key) == F.col("class")).select(F.col(key).alias("head"))
    found = overlaps.similar(df.join(heads.hint("merge"), F.col(key) == F.col("head")), text, size, key, least)
    return found.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"), (F.col("common") / F.col("of")).alias("sim")), groups


def seed_histogram(df: DataFrame, text: str, period: int, length: int, key: str, seed: Column) -> DataFrame:
    """multiplicity, n_seeds: how many distinct spaced seeds stand how often. seed: expression over gram."""
    span = (length - 1) * period + 1
    each = windows(df, text, span, key).select(seed.alias("seed")).groupBy("seed").agg(F.count("*").alias("multiplicity"))
    return each.groupBy("multiplicity").agg(F.count("*").alias("n_seeds"))


def frequent_substrings(df: DataFrame, text: str, sizes: range, key: str, least: int) -> DataFrame:
    """gram, n_seqs, n: substrings of the given lengths that stand in least texts or more. A key is one text."""
    found = tallied(df.select(F.col(text)), text, [range(size) for size in sizes])
    return found.where(F.col("n_texts") >= least).select("gram", F.col("n_texts").alias("n_seqs"), "n")
