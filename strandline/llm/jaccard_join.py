"""N-gram Jaccard join with token-combination prefixes.

A text's tokens are the 64-bit hashes of its distinct 4-word shingles. Texts with equal token sets form a class; the
join is between classes. Two sets that link share nearly all tokens, so what they share is also in short prefixes of
both, in one global token order. Tokens whose hash is divisible by COUNTED are counted over all texts; those in fewer
than FREQUENT texts come first and are indexed one by one. Where a set has too few of them, its prefix is extended by
the other tokens, which are indexed in pairs: among j tokens of a sub-class without a shared pair, j - 1 are missing at
least, so prefixes run until these add up to more than a linking partner can miss. Sub-classes, by token hash, keep the
pairs few; their number goes by the smaller set's size (a band), and a text close above a band's edge is indexed in both.

Candidates meet by index entry. Rather than all pairs, entries compare their texts with a few pivots in rounds; pairs
already in one component are never compared; what is still apart after the rounds is compared in full. So every link
between different components is found. Verification counts the exact intersection of the whole sets.

Edge cases: null or empty text has an empty set, links with nothing and is its own component; fewer than four words
are one token; very long texts are hashed in pieces, in linear time; rows that repeat a doc_id share its component; an empty table gives an empty result. Null doc_ids are
left out of links and get a null component.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import binaries, rows, stored, values

WORDS, PERCENT, COUNTED, FREQUENT, MAX_FREQUENT, MAX_SENT, HUB_TEXTS, PIVOTS, SMALL, BLOCK = 4, 85, 2, 3, 3_000_000, 32 << 20, 2000, (1, 4), 16, 256
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PIECE = 1 << 18
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _Q)
_A_BLANK = re.compile(rb"[ \t\n\r\v\f]").search
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2 ** 64."""
    back = np.uint64(pow(int(_P), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_P, back))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words between ASCII white space, without a loop over words: differences of a running polynomial sum over the bytes."""
    if len(text) <= PIECE:
        return _piece_hashes(text)
    found, at = [], 0
    while at < len(text):  # pieces that end between words
        blank = _A_BLANK(text, at + PIECE)
        stop = blank.start() if blank else len(text)
        key, start = _piece_hashes(text[at:stop])
        found.append((key, start + at))
        at = stop
    return tuple(map(np.concatenate, zip(*found)))


def _piece_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text, np.uint8)
    blank = _BLANK[codes]
    edges = np.diff(blank.astype(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    ahead, back = _powers(max(2 * PIECE, len(text)) if len(text) > PIECE else 2 * PIECE)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * ahead[: len(codes)], out=total[1:])
    return _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)), start


def token_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of size words; of all words as one where there are fewer."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) < PIECE):
            held += len(texts[stop]) + 1
            stop += 1
        lengths = np.fromiter((len(t) + 1 for t in texts[at:stop]), np.int64)
        h, start = word_hashes(b"\n".join(texts[at:stop]).lower())
        ends = np.searchsorted(start, np.cumsum(lengths))
        begins = np.concatenate([[0], ends[:-1]])
        n = max(0, len(h) - size + 1)
        key = np.full(n, size, np.uint64)
        for i in range(size):
            key = (key ^ h[i : i + n]) * _P
            key ^= key >> np.uint64(32)
        key = _mix(key)
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a >= size:
                found = np.sort(key[a : b - size + 1])
                out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for i in range(a, b):
                    one = (one ^ h[i : i + 1]) * _P
                    one ^= one >> np.uint64(32)
                out.append(_mix(one))
            else:
                out.append(np.zeros(0, np.uint64))
        at = stop
    return out


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, as two signed numbers."""
    import xxhash

    both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
    return int(both[0]), int(both[1])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[int | None, np.ndarray, tuple[int, int] | None, bool]]]:
    """Lists of (doc_id, tokens, fingerprint, whether this task has not seen the set; what it remembers is bounded)."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for b in range(0, batch.num_rows, 500):
            part, out = batch.slice(b, 500), []
            for doc_id, found in zip(values(part, "doc_id"), token_sets(binaries(part, "text"), size), strict=True):
                key = fingerprint(found) if len(found) else None
                out.append((doc_id, found, key, doc_id is not None and key is not None and key not in seen))
                if out[-1][3]:
                    seen.add(key)
            if len(seen) > 500_000:
                seen.clear()
            yield out


def frequent_tokens(docs: DataFrame, size: int = WORDS) -> np.ndarray:
    """The counted tokens in FREQUENT texts or more, sorted; the threshold doubles until they are at most MAX_FREQUENT.

    Which tokens are taken for frequent changes how many entries are indexed, never what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _sets(batches, size):
            every = np.concatenate([np.zeros(0, np.uint64), *(found for _, found, _, new in group if new)])
            token, n = np.unique(every[every % np.uint64(COUNTED) == 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int32))], names=["token", "n"])

    counted = stored(docs.mapInArrow(run, "token long, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    least = FREQUENT
    while counted.where(F.col("n") >= least).count() > MAX_FREQUENT:
        least *= 2
    found = counted.where(F.col("n") >= least).select("token").toArrow()["token"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _bands(n: int, percent: int) -> list[int]:
    """Bands (lower edge, a power of two) of the smaller set of a pair that a set of n tokens may be in."""
    least = -(-percent * n // 100)
    return sorted({1 << (m.bit_length() - 1) for m in (least, n)})


def entries(found: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set: single tokens, pairs of tokens. Sets that reach percent share one at least."""
    n = len(found)
    need = n - -(-percent * n // 100) + 1
    counted = found % np.uint64(COUNTED) == 0
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        often = frequent[at] == found
    else:
        often = np.zeros(n, bool)
    first = found[counted & ~often]
    if len(first) >= need:
        return first[:need], np.zeros(0, np.uint64)
    need -= len(first)
    rest = np.concatenate([found[~counted], found[counted & often]])
    pairs = []
    for band in _bands(n, percent):
        sub = _mix(rest * _Q) % np.uint64(max(1, band // 16))
        _, opening = np.unique(sub, return_index=True)
        credit = np.ones(len(rest), np.int64)
        credit[opening] = 0
        cut = int(np.searchsorted(np.cumsum(credit), need)) + 1
        taken, sub = rest[:cut], sub[:cut]
        order = np.argsort(sub, kind="stable")
        edges = np.flatnonzero(np.diff(sub[order].astype(np.int64), prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            group = np.sort(taken[order[a:b]])
            i, j = np.triu_indices(len(group), 1)
            pairs.append(_mix(_mix(group[i] * _P) + group[j] * _Q + np.uint64(band)))
    return first, np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)


INDEX = pa.schema([("entry", pa.int64()), ("doc_id", pa.int64()), ("print1", pa.int64()), ("print2", pa.int64()), ("n", pa.int64()), ("kind", pa.int32())])
INDEX_SQL = "entry long, doc_id long, print1 long, print2 long, n long, kind int"
SINGLE, PAIR, WHOLE, SHORT = 0, 1, 2, 3


def index(docs: DataFrame, frequent, single: bool, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The single-token or the pair entries of all sets. frequent: a broadcast array.

    With the single entries goes a row for each row of docs, of kind SHORT where its set has pair entries too, else WHOLE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _sets(batches, size):
            both = [(*g, *(entries(g[1], frequent.value, percent) if g[3] else (np.zeros(0, np.uint64),) * 2)) for g in group]
            chosen = [(x[0], x[1], x[2], x[4 if single else 5]) for x in both if x[3]]
            sizes = [len(e) for *_, e in chosen]
            flat = np.concatenate([np.zeros(0, np.uint64), *(e for *_, e in chosen)]).view(np.int64)
            spread = [np.repeat(np.array(c, np.int64), sizes) for c in ([d for d, *_ in chosen], [k[0] for _, _, k, _ in chosen], [len(f) for _, f, _, _ in chosen])]
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(spread[0]), pa.array(spread[1]), pa.nulls(len(flat), pa.int64()), pa.array(spread[2]), pa.array(np.full(len(flat), SINGLE if single else PAIR, np.int32))], schema=INDEX)
            if single:
                yield rows(INDEX, [hash((x[0], i)) for i, x in enumerate(both)], [x[0] for x in both], [x[2] and x[2][0] for x in both], [x[2] and x[2][1] for x in both], [len(x[1]) for x in both], [SHORT if len(x[5]) else WHOLE for x in both])

    return docs.mapInArrow(run, INDEX_SQL)


def candidates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """entry, doc_id (one of each class), n of all entries that two classes or more have; doc_id, n_shingles, print1, print2 of all rows."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, size))
    # single tokens stand in fewer than FREQUENT texts, so a window over one is small
    one = Window.partitionBy("entry", "kind")
    single = index(docs, frequent, True, size, percent).withColumn("low", F.min("print1").over(one)).withColumn("high", F.max("print1").over(one)).where(f"low < high or kind <> {SINGLE}").drop("low", "high")
    single = stored(single, "single")
    every = single.where(f"kind <> {SINGLE}").select("doc_id", F.col("n").alias("n_shingles"), "print1", "print2")
    short = stored(single.where(f"kind = {SHORT}").select("doc_id").distinct(), "short")
    # pairs have no such bound: they are aggregated first, and the join can be split
    pairs = stored(index(_those(docs, short), frequent, False, size, percent).groupBy("entry", "print1").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "pairs")
    shared = stored(pairs.groupBy("entry").agg(F.count("*").alias("k")).where("k > 1").select("entry"), "shared")  # written, as below: both sides of the join then have exchanges, and a crowded entry is split
    met = single.where(f"kind = {SINGLE}").groupBy("entry", "print1").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).unionByName(pairs.join(shared, "entry").select("entry", "print1", "doc_id", "n"))
    return stored(met.select("entry", "doc_id", "n"), "candidates"), every


def _those(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs joined with a written table by doc_id, which is broadcast up to MAX_SENT bytes (ids, and calls of three numbers each); a larger one is shuffled."""
    calls = F.sum(F.size("calls")) if "calls" in wanted.columns else F.lit(0)
    n, more = wanted.agg(F.count("*"), F.coalesce(calls, F.lit(0))).first()
    return docs.join(F.broadcast(wanted) if 32 * n + 24 * more <= MAX_SENT else wanted, "doc_id")


def verified(docs: DataFrame, pairs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """pairs: doc_id, hub. Adds linked: whether 100 * intersection >= percent * union of the whole sets. A written table.

    Each text is read where it lies and its tokens are sent to its hubs; a hub's own tokens come first, in every part
    that a hub with many texts is split into.
    """
    degree = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_TEXTS).alias("parts"))
    calls = pairs.join(degree, "hub").select("doc_id", F.struct("hub", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), F.lit(1).alias("turn")).alias("call"))
    split = degree.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    own = split.select(F.col("hub").alias("doc_id"), F.struct("hub", "part", F.lit(0).alias("turn")).alias("call"))
    wanted = stored(calls.unionByName(own).groupBy("doc_id").agg(F.collect_list("call").alias("calls")), "calls")
    schema = pa.schema([("hub", pa.int64()), ("part", pa.int64()), ("turn", pa.int32()), ("doc_id", pa.int64()), ("tokens", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 100):
                piece = batch.slice(b, 100)
                for doc_id, calls, found in zip(values(piece, "doc_id"), values(piece, "calls"), token_sets(binaries(piece, "text"), size), strict=True):
                    data = found.tobytes()
                    for c in range(0, len(calls), 200):
                        some = calls[c : c + 200]
                        yield rows(schema, [x["hub"] for x in some], [x["part"] for x in some], [x["turn"] for x in some], [doc_id] * len(some), [data] * len(some))

    sent = _those(docs, wanted).select("doc_id", "text", "calls").mapInArrow(send, "hub long, part long, turn int, doc_id long, tokens binary")
    out = pa.schema([("doc_id", pa.int64()), ("hub", pa.int64()), ("linked", pa.bool_())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            ids, hubs, linked = [], [], []
            for hub, turn, doc_id, data in zip(values(batch, "hub"), values(batch, "turn"), values(batch, "doc_id"), binaries(batch, "tokens"), strict=True):
                found = np.frombuffer(data, np.uint64)
                if turn == 0:
                    at, mine = hub, found
                elif hub == at:
                    both = np.concatenate([mine, found])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    ids.append(doc_id)
                    hubs.append(hub)
                    linked.append(100 * common >= percent * (len(mine) + len(found) - common))
            yield rows(out, ids, hubs, linked)

    met = sent.repartition("hub", "part").sortWithinPartitions("hub", "part", "turn").select("hub", "turn", "doc_id", "tokens")
    return stored(met.mapInArrow(compare, "doc_id long, hub long, linked boolean"), "verified")


def _fits(x, y, percent: int):
    """Whether two texts (structs of doc_id, n, component) are apart and of sizes that allow a link."""
    return (x["component"] != y["component"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of token incidence matrices over slices of the shared tokens."""
    _, place, n = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    many = n[place] > 1
    place, owner = np.unique(place[many], return_inverse=True)[1], owner[many]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        lo, hi = np.searchsorted(place, [a, a + 4096])
        held = np.zeros((len(left) + len(right), 4096), np.float32)
        held[owner[lo:hi], place[lo:hi] - a] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def block_links(docs: DataFrame, open_: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, hub, linked (true): links that join components, among all texts of entries with many texts.

    A text belongs to the class of its most shared entry. Classes that share an entry are compared in blocks of BLOCK
    texts, so a text is sent once per block of the classes that it meets, and each pair is compared once, in a task that
    holds two blocks. Only links that join what a block has apart are returned.
    """
    sized = open_.join(open_.groupBy("entry").agg(F.count("*").alias("k")), "entry")
    home = sized.groupBy("doc_id", "component").agg(F.max(F.struct("k", "entry"))["entry"].alias("class"))
    home = stored(home.join(home.groupBy("class").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "class"), "homes")
    seen = open_.select("entry", "doc_id").join(home.select("doc_id", "class", "blocks"), "doc_id").select("entry", "class", "blocks").distinct()
    x, y = seen.alias("x"), seen.alias("y")
    met = x.join(y, (F.col("x.entry") == F.col("y.entry")) & (F.col("x.class") <= F.col("y.class"))).select(F.col("x.class").alias("c1"), F.col("y.class").alias("c2"), F.col("x.blocks").alias("b1"), F.col("y.blocks").alias("b2")).distinct()
    pairs = met.select("c1", "c2", "b2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b1") - 1)).alias("i")).select("c1", "c2", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b2") - 1)).alias("j")).where("c1 < c2 or i <= j")
    tasks = stored(pairs.withColumn("task", F.monotonically_increasing_id()), "tasks")
    sides = tasks.select("task", F.col("c1").alias("class"), F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(tasks.select("task", F.col("c2").alias("class"), F.col("j").alias("block"), F.lit(1).alias("side")))
    placed = home.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).drop("blocks")
    wanted = stored(placed.join(sides, ["class", "block"]).groupBy("doc_id", "component").agg(F.collect_list(F.struct("task", "side")).alias("calls")), "calls")
    schema = pa.schema([("task", pa.int64()), ("side", pa.int32()), ("doc_id", pa.int64()), ("component", pa.int64()), ("tokens", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 100):
                piece = batch.slice(b, 100)
                for doc_id, component, calls, found in zip(values(piece, "doc_id"), values(piece, "component"), values(piece, "calls"), token_sets(binaries(piece, "text"), size), strict=True):
                    data = found.tobytes()
                    for c in range(0, len(calls), 200):
                        some = calls[c : c + 200]
                        yield rows(schema, [x["task"] for x in some], [x["side"] for x in some], [doc_id] * len(some), [component] * len(some), [data] * len(some))

    out = pa.schema([("doc_id", pa.int64()), ("hub", pa.int64()), ("linked", pa.bool_())])

    def compare(group: pa.Table) -> pa.Table:
        sides = [[], []]
        for side, *row in zip(*(group[c].to_pylist() for c in ("side", "doc_id", "component", "tokens")), strict=True):
            sides[side].append(row)
        root: dict[int, int] = {}

        def top(c):
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        if sides[0] and sides[1]:
            sets = [[np.frombuffer(r[2], np.uint64) for r in rows_] for rows_ in sides]
            common = _common(*sets)
            total = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in sets[1]])[None, :]
            for i, j in zip(*np.nonzero(100 * common >= percent * (total - common))):
                a, b = sides[0][i], sides[1][j]
                if a[0] != b[0] and top(a[1]) != top(b[1]):
                    root[top(a[1])] = top(b[1])
                    found.append((a[0], b[0]))
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([True] * len(found), pa.bool_())], schema=out)

    sent = _those(docs, wanted).select("doc_id", "component", "text", "calls").mapInArrow(send, "task long, side int, doc_id long, component long, tokens binary")
    return stored(sent.groupBy("task").applyInArrow(compare, "doc_id long, hub long, linked boolean"), "block-links")


def links(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, pivots: tuple[int, ...] = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """node, component of the classes (by one doc_id each) that link with another class; the summaries of all rows."""
    spark = docs.sparkSession
    met, every = candidates(docs, size, percent)
    open_ = met.withColumn("component", F.col("doc_id"))
    tested = spark.createDataFrame([], "doc_id long, hub long, linked boolean")
    labels = spark.createDataFrame([], "node long, component long")
    item = F.struct("doc_id", "n", "component")
    for step, k in enumerate((*pivots, 0)):
        blocks = None
        if k:
            ranks = [F.min(F.struct(F.xxhash64("doc_id", F.lit(100 * step + i)).alias("r"), item.alias("x")))["x"] for i in range(k)]
            chosen = stored(open_.groupBy("entry").agg(F.array_distinct(F.array(*ranks)).alias("pivots")), "pivots")
            pairs = open_.join(chosen.hint("merge"), "entry").select(item.alias("x"), F.explode("pivots").alias("y"))
        else:  # in full: pairs of entries with few texts, blocks of those with many
            counts = stored(open_.groupBy("entry").agg(F.count("*").alias("k")), "entry-counts")
            few = open_.join(counts.where(F.col("k") <= SMALL).select("entry"), "entry")
            many = stored(open_.join(counts.where(F.col("k") > SMALL).select("entry"), "entry"), "many")
            blocks = None if many.isEmpty() else block_links(docs, many, size, percent)
            pairs = few.select("entry", item.alias("x")).join(few.select("entry", item.alias("y")), "entry").where("x.doc_id < y.doc_id").select("x", "y")
        low, high = F.least("x.doc_id", "y.doc_id").alias("low"), F.greatest("x.doc_id", "y.doc_id").alias("high")
        new = pairs.where(_fits(F.col("x"), F.col("y"), percent)).groupBy(low, high).agg(F.min("y.doc_id").alias("hub"))
        seen = tested.select(F.least("doc_id", "hub").alias("low"), F.greatest("doc_id", "hub").alias("high"))
        new = stored(new.join(seen, ["low", "high"], "left_anti").select((F.col("low") + F.col("high") - F.col("hub")).alias("doc_id"), "hub"), "new-pairs")
        if not new.isEmpty():
            tested = tested.unionByName(verified(docs, new, size, percent))
        if blocks is not None:
            tested = tested.unionByName(blocks)
        labels = components(tested.where("linked").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
        if not k:
            break
        # entries whose texts are in one component have nothing left to compare
        moved = stored(open_.drop("component").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "open")
        apart = stored(moved.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("entry"), "apart")
        open_ = stored(moved.join(apart.hint("merge"), "entry"), "open")
        if open_.isEmpty():
            break
    return labels, every


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    labels, every = links(docs, size, percent)
    classes = every.where("print1 is not null and doc_id is not null").groupBy("print1", "print2").agg(F.min("doc_id").alias("least"))
    known = every.where("print1 is not null").join(labels.withColumnRenamed("node", "doc_id"), "doc_id").select("print1", "print2", "component").distinct()
    labelled = stored(classes.join(known, ["print1", "print2"], "left"), "classes")
    lowest = labelled.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    named = labelled.join(lowest, "component", "left").select("print1", "print2", F.coalesce("lowest", "least").alias("component_id"))
    return every.join(named, ["print1", "print2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose doc_id isn't its component's smallest; of rows that repeat a doc_id, the first by text stays."""
    found = stored(join(docs, size, percent), "joined")
    more = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    few = 32 * more.count() <= MAX_SENT
    kept = docs.join(F.broadcast(more) if few else more, "doc_id", "left_anti").select(*docs.columns)
    twice = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("jaccard_rows")).where("jaccard_rows > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        return kept
    place = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    again = kept.join(twice, "doc_id", "left_semi").withColumn("jaccard_place", F.row_number().over(place)).where("jaccard_place = 1")
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
