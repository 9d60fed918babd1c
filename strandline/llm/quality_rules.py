r"""Quality rules: base counts per text, then perplexity bands of a modified Kneser-Ney model per language.

The model is over the characters of whole texts that pass the base rules, order ORDER: words (between ASCII white space)
with one blank between them, so n-grams run across word boundaries and the order of words counts. A character is its
code point; those from FOLD on share FOLD symbols, so that a window is one 55-bit number. Nothing is pruned: n-gram
counts, continuation counts, discounts (per language) and probabilities are Spark aggregations and joins over all
n-grams of all rows. As the texts scored are those counted, every n-gram of a text is in the model; so that a text
doesn't vouch for itself, an n-gram that one text alone has (with its exact copies) is scored as if it were unseen, by
backing off. Which text that is, is told by TAG_BITS bits of its hash: of the n-grams in two texts, one in 512 is taken
for one text's.

Scoring looks windows up in sorted hash arrays. Where the model has MODEL_ROWS n-grams at most it is sent to the tasks;
a larger one stays a table: tasks bundle texts (about BUNDLE bytes each), a bundle's distinct n-grams are joined to the
model, and the bundle meets its losses again. Both ways give the same losses. A text is rejected where its log loss per
letter lies outside its language's band, which runs from the lower quartile less BELOW times the interquartile range to
the upper quartile plus ABOVE times it, both times sqrt(1 + SHORT / n_words), as short texts vary more. Loss is taken
per letter, so signs between the words add to it.

Edge cases: null text has no words and fails the base rules; a null language is a language of its own, apart from an
empty one; a language with fewer than MIN_DOCS judged texts has no band, and its texts pass; a text without letters
counts as one letter; very long texts are taken whole (one must fit in a task's memory); rows that repeat a doc_id are
judged each; columns of docs that are kept may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binaries, pieces, rows, stored, values, widened

ORDER, BITS, FOLD, TAG_BITS, BUNDLE, MODEL_ROWS = 5, 11, 1024, 9, 16_000_000, 8_000_000
MIN_WORDS, REPEAT_PERCENT, BELOW, ABOVE, SHORT, MIN_DOCS = 10, 20, 8.0, 4.0, 60, 20
START, END, SYMBOLS, WINDOW, PIECE, HELD = "\x02", "\x03", b"#*$%&|<>", 5, 1 << 20, 1 << 22
_P = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes]) -> int:
    """Words inside WINDOW-word windows that stand twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        key = (key ^ h[i : i + n]) * _P
        key ^= key >> np.uint64(29)
    found = np.sort(key)
    if (found[1:] != found[:-1]).all():
        return 0
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return len(lines) - len(set(lines))


def base_counts(text: bytes, characters: int, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    blanks = len(text) - sum(map(len, words))
    return len(words), characters - blanks, len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), repeated_words(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MARKS = str.maketrans({START: "\ufffd", END: "\ufffd"})


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def sequence(words: list[bytes]) -> str:
    """The symbols of a text: its words with one blank between, START before and END after; marks that stand in the text are replaced. Empty where there are no words."""
    text = b" ".join(words).decode("utf-8", "replace")
    if START in text or END in text:
        text = text.translate(_MARKS)
    return START * (ORDER - 1) + text + END if text else ""


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)


def windows(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (each as its words) as numbers; how many windows, and how many letters, each text has."""
    parts = [sequence(t) for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
    edges = np.cumsum([0, *map(len, parts)])
    narrow = np.where(codes < FOLD, codes, FOLD + codes % FOLD).astype(np.uint64)
    real = codes != ord(START)  # every such symbol ends a window
    at = np.flatnonzero(real)
    key = narrow[at - ORDER + 1]
    for i in reversed(range(ORDER - 1)):
        key = (key << np.uint64(BITS)) | narrow[at - i]
    counted = [np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[edges]) for x in (real, _letters()[codes])]
    return key, *counted


def hashed(key: np.ndarray) -> np.ndarray:
    """A bijection that spreads windows evenly."""
    key = key * _P
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(29))


def tagged(texts: list[list[bytes]]) -> np.ndarray:
    """All windows of the texts, with the tag of their text in the lowest bits."""
    key, sizes, _ = windows(texts)
    tags = np.fromiter((zlib.crc32(b" ".join(t)) >> (32 - TAG_BITS) for t in texts), np.uint64, len(texts))
    return (key << np.uint64(TAG_BITS)) | np.repeat(tags, sizes)


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows, sorted, their counts, and their lowest and highest tag."""
    key = np.sort(key)
    gram = key >> np.uint64(TAG_BITS)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]]))
    last = np.append(first[1:], len(gram)) - 1 if len(first) else first
    mask = np.uint64((1 << TAG_BITS) - 1)
    return gram[first], last - first + 1, (key[first] & mask).astype(np.int16), (key[last] & mask).astype(np.int16)


def merged(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    gram, n, low, high = map(np.concatenate, zip(*runs))
    order = np.argsort(gram)
    gram = gram[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]]))
    return (gram, n, low, high) if not len(first) else (gram[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first))


class Tally:
    """Counts of windows by language; sorted in runs, so memory goes by the distinct ones."""

    def __init__(self):
        self.open, self.done = {}, {}

    def add(self, lang: str | None, key: np.ndarray) -> None:
        self.open.setdefault(lang, []).append(key)
        if sum(map(len, self.open[lang])) > HELD:
            self._close(lang)

    def _close(self, lang: str | None) -> None:
        runs = self.done.setdefault(lang, [])
        runs.append(counted(np.concatenate(self.open.pop(lang))))
        if len(runs) == 8:
            self.done[lang] = [merged(runs)]

    def items(self) -> Iterator[tuple[str | None, tuple[np.ndarray, ...]]]:
        for lang in list(self.open):
            self._close(lang)
        for lang, runs in self.done.items():
            yield lang, merged(runs)


def _passing(part: pa.RecordBatch) -> Iterator[tuple[str | None, list[list[bytes]]]]:
    """The texts of a piece that pass the base rules, as words, by language."""
    texts, langs = binaries(part, "text"), values(part, "lang")
    words = [t.split() for t in texts]
    fine = [not base_fails(len(w), repeated_words(w)) for w in words]
    for lang in set(langs):
        yield lang, [w for w, x, f in zip(words, langs, fine, strict=True) if f and x == lang]


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n, low, high (tags) of the windows of all texts that pass the base rules. docs: text, lang."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64()), ("low", pa.int16()), ("high", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                for lang, texts in _passing(part):
                    tally.add(lang, tagged(texts))
        for lang, found in tally.items():
            for b in range(0, len(found[0]), 200_000):
                key, n, low, high = (x[b : b + 200_000] for x in found)
                yield rows(schema, [lang] * len(key), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(low), pa.array(high))

    sent = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long, low short, high short")
    return sent.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def gram_losses(grams: DataFrame) -> DataFrame:
    """lang, gram, loss (float): minus the log probability of each window's last symbol after the others, from what count_grams() returns.

    A window of one text is unseen: its context's back-off weight (1, if the context is that text's too) times the shorter window's probability.
    """
    levels = [stored(grams.select("lang", "gram", F.col("n").cast("double").alias("a"), "low", "high"), "level")]
    for k in range(ORDER - 1, 0, -1):
        # continuation counts; windows at the start keep their plain counts
        shorter = levels[-1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")).agg(F.sum("a").alias("plain"), F.count("*").alias("left"), F.min("low").alias("low"), F.max("high").alias("high"))
        starts = F.shiftright("gram", BITS * (k - 1)) == ord(START)
        levels.append(stored(shorter.select("lang", "gram", F.when(starts, F.col("plain")).otherwise(F.col("left")).cast("double").alias("a"), "low", "high"), "level"))
    levels.reverse()
    every = levels[0].withColumn("k", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        every = every.unionByName(level.withColumn("k", F.lit(k)))
    few = every.groupBy("lang", "k").agg((1 / (F.count("*") + 1)).alias("below"), *(F.count_if(F.col("a") == i).cast("double").alias(f"n{i}") for i in range(1, 5)))
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.least(F.lit(float(i)), F.greatest(F.lit(0.1 * i), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(0.5 * i) for i in (1, 2, 3)]
    cuts = stored(few.select(F.col("lang").alias("of"), "k", "below", *(x.alias(f"d{i}") for i, x in enumerate(d, 1))), "discounts")
    for k, level in enumerate(levels, 1):
        cut = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        each = level.join(cuts.where(F.col("k") == k), F.col("lang").eqNullSafe(F.col("of"))).select("lang", "gram", "a", "low", "high", cut.alias("d"), "below", F.shiftright("gram", BITS).alias("context"))
        sums = each.groupBy(F.col("lang").alias("of"), F.col("context").alias("after")).agg(F.sum("a").alias("total"), F.sum("d").alias("gamma"), (F.min("low") == F.max("high")).alias("own_context"))
        both = each.join(sums, F.col("lang").eqNullSafe(F.col("of")) & (F.col("context") == F.col("after"))).select("lang", "gram", "a", "d", "total", "gamma", "below", "own_context", (F.col("low") == F.col("high")).alias("own"))
        if k > 1:
            ending = lower.select(F.col("lang").alias("of"), F.col("gram").alias("ending"), F.col("p").alias("shorter"))  # noqa: F821
            mine = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))
            both = both.join(ending, F.col("lang").eqNullSafe(F.col("of")) & (mine == F.col("ending"))).withColumn("below", F.col("shorter"))
        weight = F.col("gamma") / F.col("total")
        p = F.when(~F.col("own"), (F.col("a") - F.col("d")) / F.col("total") + weight * F.col("below")).when(F.col("own_context"), F.col("below")).otherwise(weight * F.col("below"))
        lower = stored(both.select("lang", "gram", p.alias("p")), "probabilities")
    return lower.select("lang", "gram", (-F.log("p")).cast("float").alias("loss"))


class Losses:
    """Losses by window, in sorted arrays of hashes that hold every window asked for: high bits lead near."""

    def __init__(self, keys: np.ndarray, losses: np.ndarray):
        """keys: hashes, sorted."""
        bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        self.keys, self.losses, self.shift = keys, losses, np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.uint32)

    def find(self, windows: np.ndarray) -> np.ndarray:
        keys = hashed(windows)
        at = self.first[keys >> self.shift].astype(np.int64)
        open_ = np.flatnonzero(self.keys[at] != keys)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        return self.losses[at]


def sorted_losses(langs: pa.ChunkedArray, grams: np.ndarray, losses: np.ndarray) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Sorted hash arrays of each language."""
    coded = langs.combine_chunks().dictionary_encode(null_encoding="encode")
    number, out = coded.indices.to_numpy(zero_copy_only=False), {}
    for i, lang in enumerate(coded.dictionary.to_pylist()):
        keys, mine = hashed(grams[number == i].view(np.uint64)), losses[number == i]
        order = np.argsort(keys)
        out[lang] = keys[order], mine[order]
    return out


def _measured(part: pa.RecordBatch, kept: dict[str, str], find: Callable[[str | None], Losses]) -> pa.RecordBatch:
    """The kept columns (under their names in kept) of a piece, its base counts, base_failed and loss."""
    texts, langs = binaries(part, "text"), values(part, "lang")
    characters = [n or 0 for n in pc.utf8_length(part.column(part.schema.get_field_index("text"))).to_pylist()]
    words = [t.split() for t in texts]
    counts = [base_counts(t, n, w) for t, n, w in zip(texts, characters, words, strict=True)]
    failed = [base_fails(c[0], c[4]) for c in counts]
    losses: list[float | None] = [None] * len(texts)
    for lang in set(langs):
        at = [i for i, x in enumerate(langs) if x == lang and not failed[i]]
        if at:
            key, sizes, letters = windows([words[i] for i in at])
            sums = np.add.reduceat(find(lang).find(key).astype(np.float64), np.cumsum(sizes) - sizes)
            for i, x in zip(at, (sums / np.maximum(letters, 1)).tolist(), strict=True):
                losses[i] = x
    old = [part.column(part.schema.get_field_index(c)) for c in kept]
    new = [*(pa.array(x, pa.int64()) for x in zip(*counts)), pa.array(failed, pa.bool_()), pa.array(losses, pa.float64())]
    return pa.RecordBatch.from_arrays(old + new, names=[*kept.values(), *COUNTS, "base_failed", "loss"])


_found: dict[str, dict[str | None, Losses]] = {}


def measure(docs: DataFrame, kept: dict[str, str], model_rows: int = MODEL_ROWS) -> DataFrame:
    """docs: text, lang and the columns named in kept, which go on under the names given there; adds COUNTS, base_failed
    and loss (the log loss per letter, null where the base rules fail)."""
    model = stored(gram_losses(count_grams(docs)), "model")
    plain = docs.select(*(F.col(c).alias(n) for c, n in kept.items()))
    schema = widened(plain, **dict.fromkeys(COUNTS, "long"), base_failed="boolean", loss="double")
    if model.count() > model_rows:
        return _by_bundles(docs, kept, model, schema)
    table = model.toArrow()  # model_rows at most
    shared = docs.sparkSession.sparkContext.broadcast(sorted_losses(table["lang"], table["gram"].to_numpy(), table["loss"].to_numpy()))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _found:
            _found.clear()
            _found[name] = {lang: Losses(*x) for lang, x in shared.value.items()}
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                yield _measured(part, kept, _found[name].__getitem__)

    return docs.mapInArrow(run, schema)


def bundles(docs: DataFrame) -> DataFrame:
    """A written table of bundle, block, lang, grams. Rows with a block hold a piece of docs as Arrow stream; the others a bundle's distinct windows of a language."""
    schema = pa.schema([("bundle", pa.string()), ("block", pa.binary()), ("lang", pa.string()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, tally = uuid.uuid4().hex, 0, Tally()

        def sent():
            for lang, (key, *_) in tally.items():
                for b in range(0, len(key), 100_000):
                    yield rows(schema, [name], [None], [lang], [key[b : b + 100_000].view(np.int64)])

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                for lang, texts in _passing(part):
                    tally.add(lang, tagged(texts))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield rows(schema, [name], [sink.getvalue().to_pybytes()], [None], [None])
                size += part.nbytes
                if size > BUNDLE:
                    yield from sent()
                    name, size, tally = uuid.uuid4().hex, 0, Tally()
        yield from sent()

    return stored(docs.mapInArrow(run, "bundle string, block binary, lang string, grams array<bigint>"), "bundles")


def _by_bundles(docs: DataFrame, kept: dict[str, str], model: DataFrame, schema) -> DataFrame:
    whole = bundles(docs)
    asked = whole.where("block is null").select(F.col("bundle").alias("to"), F.col("lang").alias("of"), F.explode("grams").alias("asked"))
    wanted = asked.join(model, F.col("of").eqNullSafe(F.col("lang")) & (F.col("asked") == F.col("gram"))).select("to", "lang", "gram", "loss")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {lang: Losses(*x) for lang, x in sorted_losses(right["lang"], right["gram"].to_numpy(), right["loss"].to_numpy()).items()}
        blocks = (part for block in left["block"].to_pylist() for part in pa.ipc.open_stream(block))
        return pa.Table.from_batches([_measured(part, kept, found.__getitem__) for part in blocks])

    blocks = whole.where("block is not null").select("bundle", "block")
    return blocks.groupBy("bundle").cogroup(wanted.groupBy("to")).applyInArrow(run, schema)


def bands(measured: DataFrame, lang: str) -> DataFrame:
    """of, low, high, below, above of each language: quartiles of the texts that pass the base rules, and how far the band goes beyond them. A written table."""
    q = F.percentile_approx("loss", [0.25, 0.75], 10_000)
    found = measured.where("loss is not null").groupBy(F.col(lang).alias("of")).agg(q.alias("q"), F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    width = F.col("q")[1] - F.col("q")[0]
    return stored(found.select("of", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), (BELOW * width).alias("below"), (ABOVE * width).alias("above")), "bands")


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc (a struct of the columns of docs named in keep), COUNTS, base_failed, loss and kept: a row per row of docs."""
    chosen = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.struct(*keep).alias("doc"))
    measured = stored(measure(chosen, {"doc": "doc", "lang": "lang"}), "quality")
    banded = measured.join(bands(measured, "lang"), F.col("lang").eqNullSafe(F.col("of")), "left")  # a row per language
    wider = F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))
    inside = F.col("low").isNull() | F.col("loss").isNull() | F.col("loss").between(F.col("low") - F.col("below") * wider, F.col("high") + F.col("above") * wider)
    return banded.select("doc", *COUNTS, "base_failed", "loss", (~F.col("base_failed") & inside).alias("kept"))
