"""URL filters: explicit host and path rules, then association rules mined from labelled URLs.

A URL's tokens are its host labels and registrable tail, path words, file ending and query keys. FP-growth over the
labelled URLs finds token combinations, tokens that stand in the same URLs counting as one; those that point to bad labels with enough support and confidence, and with
more confidence than every shorter rule inside them, and whose bad labels chance doesn't explain, are kept. An inverted index from token to rules matches them: a
rule fires where all of its items meet the URL.

Edge cases: a URL that is null or has no :// has empty host and path and no tokens, and is allowed unless a rule says
else; labels that are null are left out; without labels no rule is mined; equal URLs are judged alike, and null or repeated
page_ids each; very long URLs only have more tokens, and those that always come together cost no more than one; an empty table gives an empty result. The rules are written, so that
their size says whether their index is sent to all tasks or joined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Explicit rules: host, path start, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Share of the labelled URLs that a rule covers at least, at least so many of them, how many of those are bad, and the
#: likelihood ratio (twice its log) against the share of bad URLs as a whole: chance among many rules seldom reaches it.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_EVIDENCE = 0.002, 5, 0.6, 12.0
BAD = "label=bad"


def _rest(url: Column) -> Column:
    """What follows the first ://, else null."""
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for name, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """Distinct tokens, one for each fact: the host's last two labels, the labels before them, path words, file ending, query keys."""
    labels = F.filter(F.split(F.regexp_replace(host_, r"[^.]*\.[^.]*$", ""), r"\."), lambda x: x != "")
    before = F.transform(labels, lambda x: F.concat(F.lit("host:"), x))
    tail = F.array(F.concat(F.lit("tail:"), F.regexp_extract(host_, r"([^.]*\.?[^.]*)$", 1)))
    words = F.transform(F.regexp_extract_all(F.regexp_replace(F.lower(path_), r"\.[a-z]+$", ""), F.lit(r"([a-z][a-z_-]*)(?=/|$)"), 1), lambda x: F.concat(F.lit("path:"), x))
    ending = F.filter(F.array(F.concat(F.lit("ending:"), F.regexp_extract(path_, r"\.([A-Za-z]+)$", 1))), lambda x: x != "ending:")
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1), lambda x: F.concat(F.lit("key:"), x))
    return F.when(host_ == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(before, tail, words, ending, keys)))


def judged(pages: DataFrame) -> DataFrame:
    """pages with page_id and url: page_id, url, host, path, tokens, explicit."""
    parts = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    return parts.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("explicit", explicit(F.col("host"), F.col("path")))


def token_classes(known: DataFrame) -> DataFrame:
    """known: row, tokens. token, item: tokens that stand in the same rows are one item, named by the smallest of them."""
    each = known.select("row", F.explode("tokens").alias("token"))
    prints = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64(F.lit(7), "row")).alias("two"))
    alike = ["n", "one", "two"]
    return prints.join(prints.groupBy(*alike).agg(F.min("token").alias("item")), alike).select("token", "item")


def mine_items(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_evidence: float = MIN_EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """labelled: tokens, bad (boolean). The pruned rules (rule_id, items, size, confidence, support in rows) and the items (token, item), as written tables.

    Tokens of equal rows are mined as one item: however many of them there are, they have one set instead of all their
    subsets. A rule asks for one token of each of its items, as tokens of an item say the same.
    """
    spark, empty = labelled.sparkSession, "rule_id long, items array<string>, size int, confidence double, support long"
    known = stored(labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select("bad", F.array_distinct("tokens").alias("tokens"), F.monotonically_increasing_id().alias("row")), "labelled-urls")
    rows = known.count()
    if rows == 0:
        return spark.createDataFrame([], empty), spark.createDataFrame([], "token string, item string")
    classes = stored(token_classes(known), "items")
    least = max(min_support * min_confidence, MIN_COUNT * min_confidence / rows)
    sets = known.select("row", "bad", F.explode("tokens").alias("token")).join(classes, "token").groupBy("row", "bad").agg(F.collect_set("item").alias("items"))  # items of one URL
    labelled_sets = sets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    frequent = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(labelled_sets).freqItemsets
    split = frequent.select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.array_contains("items", BAD).alias("with_bad"), "freq").where(F.size("items") > 0)
    both = split.groupBy("items").agg(F.max(F.when(F.col("with_bad"), F.col("freq"))).alias("bad"), F.max(F.when(~F.col("with_bad"), F.col("freq"))).alias("support"))
    share, n, k = known.agg(F.avg(F.col("bad").cast("double"))).first()[0], F.col("support"), F.coalesce("bad", F.lit(0))
    good = F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)
    sure = (k > n * share) & (2 * (k * F.log(k / (n * share)) + good) >= min_evidence)
    passes = (n >= max(min_support * rows, MIN_COUNT)) & (k >= min_confidence * n) & sure
    judged_sets = stored(both.select("items", F.size("items").alias("size"), (k / n).alias("confidence"), "support", F.coalesce(passes, F.lit(False)).alias("passes")), "item-sets")
    rules = unbeaten(judged_sets).select(F.xxhash64("items").alias("rule_id"), "items", "size", "confidence", "support")
    return stored(rules, "rules"), classes


def unbeaten(sets: DataFrame) -> DataFrame:
    """sets: items, size, confidence, support, passes; with a set all its subsets. Those that pass and are surer than every smaller set inside them that passes.

    Size by size, a set learns the best confidence inside it from the sets that lack one of its items.
    """
    top = sets.agg(F.max("size")).first()[0] or 0
    kept = below = None
    for size in range(1, top + 1):
        now = sets.where(F.col("size") == size)
        if below is None:
            known = now.withColumn("inside", F.lit(None).cast("double"))
        else:
            lacking = now.select("items", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
            known = now.join(lacking.join(below, "part").groupBy("items").agg(F.max("best").alias("inside")), "items", "left")
        known = stored(known, "sized-sets")
        below = known.select(F.col("items").alias("part"), F.greatest("inside", F.when(F.col("passes"), F.col("confidence"))).alias("best"))
        good = known.where("passes and (inside is null or inside < confidence)").drop("inside")
        kept = good if kept is None else kept.unionByName(good)
    return sets.where("false") if kept is None else kept


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_evidence: float = MIN_EVIDENCE) -> DataFrame:
    """The rules spelled out: rule_id, tokens, size, confidence, support for each choice of a token of every item."""
    rules, classes = mine_items(labelled, min_support, min_confidence, min_evidence)
    members = classes.groupBy("item").agg(F.collect_list("token").alias("members"))
    each = rules.select("*", F.explode("items").alias("item")).join(members, "item").groupBy("rule_id", "size", "confidence", "support").agg(F.collect_list("members").alias("choices"))
    start = F.array(F.array().cast("array<string>"))
    spelled = F.aggregate("choices", start, lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda t: F.array_append(d, t)))))
    chosen = each.select("size", "confidence", "support", F.explode(spelled).alias("picked")).withColumn("tokens", F.array_sort("picked"))
    return chosen.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "size", "confidence", "support")


def apply_rules(parts: DataFrame, rules: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """parts as judged() returns them. Adds mined (the tokens of the surest rule that fires) and its confidence.

    rules: as mine() returns them, or with classes as mine_items() returns both. The inverted index leads from an item to its rules.
    """
    met = parts.select("page_id", "url", F.explode("tokens").alias("token")).distinct()
    met = met.withColumn("item", F.col("token")) if classes is None else met.join(classes, "token").groupBy("page_id", "url", "item").agg(F.max("token").alias("token"))
    index = rules.select(F.explode("tokens" if classes is None else "items").alias("item"), "rule_id", "size", "confidence")
    fired = met.join(index, "item").groupBy("page_id", "url", "rule_id").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_list("token")), " + ").alias("mined")).where("n = size")
    best = fired.groupBy("page_id", "url").agg(F.max(F.struct("confidence", "mined")).alias("best"))
    found = best.select(F.col("page_id").alias("found_id"), F.col("url").alias("found_url"), "best")
    return parts.join(found, F.col("page_id").eqNullSafe(F.col("found_id")) & F.col("url").eqNullSafe(F.col("found_url")), "left").select(parts["*"], F.col("best.mined").alias("mined"), F.col("best.confidence").alias("mined_confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, label_key: Column) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, mined_confidence. labels: label_id, bad; label_key: a page's label_id, from its url."""
    parts = judged(pages)
    known = parts.withColumn("label_id", label_key).join(labels.select("label_id", "bad"), "label_id").select("tokens", "bad")
    out = apply_rules(parts, *mine_items(known))
    verdict = F.coalesce(F.col("explicit.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("explicit.rule").alias("rule"), verdict.alias("verdict"), "mined", "mined_confidence")
