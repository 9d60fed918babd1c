"""How filters interact: what each of the 120 orders of five filters removes at each step, by part of the corpus.

A document's failures are a mask of five bits, so a part's documents come down to 32 counts. Orders are numbered by
their Lehmer rank, that is lexicographically; those that begin with the same letters are one interval of ranks. A mask
is removed at the step whose letter is the first of its own, which holds on the intervals of all prefixes of other
letters with one of its own behind them. So each mask's counts are added where such an interval begins and taken off
where it ends, and a running sum over the ranks gives what every order removes at every step.

Failures: A under 200 words; B fewer distinct words than half of all; C over 2 percent capital letters A-Z; D any of
``# $ % & * |``; E a text that a document with a smaller doc_id has too, anywhere in the table.

Edge cases: null text is empty; a null source is the part of the empty string; rows with a null doc_id fail E in no
case and make nobody fail it; rows that repeat the smallest doc_id of a text don't fail E, as no smaller one has it;
a document is good or toxic if any of its labels says so, and neither without labels; equal texts are told by SHA-256,
so very long texts only cost their reading; an empty table has no parts and gives no rows; other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
RANKS = factorial(len(FILTERS))
STEPS = range(1, len(FILTERS) + 1)


def intervals(letters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, begin, end): the half-open intervals of ranks on which a mask's first own letter stands at the step. Bit i is letter i."""
    n, found = len(letters), []
    for step in range(1, n + 1):
        width = factorial(n - step)
        for index, prefix in enumerate(permutations(range(n), step)):  # in lexicographic order, each the start of width ranks
            before = sum(1 << i for i in prefix[:-1])
            found += [(mask, step, index * width, (index + 1) * width) for mask in range(1 << n) if mask >> prefix[-1] & 1 and not mask & before]
    return found


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of the failures A to D), print (of the text): a narrow row per document."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = thin.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return split.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("print"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E), n, good, toxic: at most 32 rows for each part.

    The text is read once. Copies meet in sums of their prints, so that a text's many copies are one row from each task,
    and come back by a join whose crowded keys adaptive execution splits.
    """
    narrow = stored(facts(docs), "filter-facts")
    copied = narrow.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    smallest = stored(copied.select(F.col("print").alias("of"), "least"), "copied-texts")  # a side with its own exchange, so that a crowded print is split
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = narrow.join(marked, F.col("doc_id") == F.col("labelled"), "left").join(smallest, F.col("print") == F.col("of"), "left")
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    return known.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _has(i: int) -> Column:
    return F.col("mask").bitwiseAND(F.lit(1 << i)) > 0


def interactions(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """counts: as mask_counts() returns them. A row per part, filter_order and step."""
    sums = ("n", "good", "toxic")
    ends = [(m, s, at, sign) for m, s, begin, end in intervals() for at, sign in ((begin, 1), (end, -1)) if at < RANKS]
    edges = F.broadcast(spark.createDataFrame(ends, "mask int, step int, rank int, sign int"))  # fixed: fewer than 2,000 rows
    orders = F.broadcast(spark.createDataFrame([(r, "".join(p)) for r, p in enumerate(permutations(FILTERS))], "rank int, filter_order string"))

    changes = counts.join(edges, "mask").select("part", "rank", *(F.when(F.col("step") == s, F.col("sign") * F.col(c)).otherwise(0).alias(f"{c}{s}") for s in STEPS for c in sums))
    changes = changes.groupBy("part", "rank").agg(*(F.sum(c).alias(c) for c in changes.columns[2:]))
    whole = counts.groupBy("part").agg(F.sum("n").alias("total"), *(F.sum(F.when(_has(i), F.col("n")).otherwise(0)).alias(f"fails_{f}") for i, f in enumerate(FILTERS)), *(F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only_{f}") for i, f in enumerate(FILTERS)))
    every = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(RANKS - 1))).alias("rank")).join(changes, ["part", "rank"], "left").join(orders, "rank")

    upto = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # 120 rows
    swept = every.select("part", "rank", "filter_order", "total", *(c for c in whole.columns if "_" in c), *(F.coalesce(F.sum(f"{c}{s}").over(upto), F.lit(0)).alias(f"{c}{s}") for s in STEPS for c in sums))
    at = [F.substring("filter_order", s, 1) for s in STEPS]
    share = {f: F.sum(sum((F.when(at[s - 1] == f, F.col(f"n{s}")).otherwise(0) for s in STEPS), F.lit(0))).over(Window.partitionBy("part")) for f in FILTERS}
    swept = swept.withColumns({f"shapley_{f}": total for f, total in share.items()})

    def of(kind: str, s: int) -> Column:
        """The column of the filter that stands at the step."""
        return F.coalesce(*(F.when(at[s - 1] == f, F.col(f"{kind}_{f}")) for f in FILTERS)).cast("long")

    def row(s: int) -> Column:
        removed = F.col(f"n{s}")
        kept = F.col("total") - sum((F.col(f"n{i}") for i in range(1, s + 1)), F.lit(0))
        columns = {"step": F.lit(s), "kept": kept, "removed": removed, "redundant": of("fails", s) - removed, "unique_fails": of("only", s), "good_lost": F.col(f"good{s}"), "toxic_lost": F.col(f"toxic{s}"), "shapley": of("shapley", s)}
        return F.struct(*(c.cast("int" if name == "step" else "long").alias(name) for name, c in columns.items()))

    return swept.select("part", "filter_order", F.inline(F.array(*(row(s) for s in STEPS))))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. docs: doc_id, text, source; labels: doc_id, quality, toxic."""
    counts = stored(mask_counts(docs, labels), "filter-counts")  # at most 32 rows for each part, read twice
    return interactions(docs.sparkSession, counts)
