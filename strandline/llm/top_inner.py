"""Exact top-k inner products over integer vectors: norm-sorted, with SVD-rotated partial sums and residual bounds.

Vectors are range-partitioned by descending length. All are rotated by the right singular vectors of the whole table,
from its Gram matrix, which gathers most of an inner product in the first HEAD dimensions. Queries meet the vectors in blocks: a
block pair is cut off where length times length falls below the query's k-th score so far, then where the partial
product of the heads plus the product of the residual lengths (Cauchy-Schwarz) does; what is left is scored in integers.
Bounds are widened by SLACK for rounding, so results are exact.

Query blocks hold queries of like need (the length below which no vector can reach their k-th score so far), and a block
of vectors only meets the query blocks whose need it reaches: the others are left out before any row moves.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part; nor do those whose scaled length
is 2 ** 31 or more, as their scores may not fit a long (all others' do, exactly); vectors of unlike dimension
are padded with zeros; null ids take no part; rows that repeat an id all count, except that rows with the query's own id are no candidates; ties go to the smaller id; a query
with fewer candidates returns them all; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, values

HEAD, SLACK, QUERY_BLOCK, VECTOR_BLOCK, SEED_ROWS, SALT, MAX_SENT, LONGEST = 16, 1e-6, 2048, 4096, 2048, 8, 32 << 20, 2.0**31


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array<long> of floor(scale * x)), norm (squared length) of the rows that take part."""
    scaled = F.transform("embedding", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    sure = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(F.lit(float(scale)) * e.cast("double")) < LONGEST))
    fine = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(sure)
    coded = fine.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return coded.withColumn("norm", norm).where(F.col("norm") < LONGEST**2)


def _matrix(batch_values: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(batch_values), width), np.int64)
    for i, v in enumerate(batch_values):
        out[i, : len(v)] = v
    return out


def rotation(coded: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, by their Gram matrix of width x width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(values(batch, "v"), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.ravel().tolist()])], names=["k", "gram"])

    parts = coded.select("v").mapInArrow(run, "k long, gram array<double>")
    cells = parts.select(F.posexplode("gram").alias("cell", "x")).groupBy("cell").agg(F.sum("x").alias("x")).toPandas()  # width * width rows
    gram = np.zeros(width * width)
    gram[cells["cell"].to_numpy()] = cells["x"].to_numpy()
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()


class Block:
    """Ids, integer vectors, rotated heads, residual lengths and lengths."""

    def __init__(self, ids, vectors: np.ndarray, turn: np.ndarray):
        self.ids, self.vectors = np.asarray(ids, np.int64), vectors
        turned = vectors @ turn
        self.head = turned[:, :HEAD]
        self.rest = np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))
        self.length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))


def search_block(queries: Block, block: Block, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best of the block (by score, then smaller id) that may be among its k best of all. floors: scores surely reached k times, less a little for rounding."""
    order = np.argsort(-block.length, kind="stable")
    lengths = block.length[order]
    for q in range(len(queries.ids)):
        limit = floors[q]
        # lengths fall: |q| |x| bounds every later product
        n = len(order) if limit <= 0 else int(np.searchsorted(-lengths * queries.length[q], -limit, "right"))
        near = order[:n]
        bound = block.head[near] @ queries.head[q] + block.rest[near] * queries.rest[q]
        near = near[bound + SLACK * (1 + np.abs(bound)) >= limit]
        near = near[block.ids[near] != queries.ids[q]]
        scores = block.vectors[near] @ queries.vectors[q]
        if len(near) > k:
            best = np.lexsort((block.ids[near], -scores))[:k]
            near, scores = near[best], scores[best]
        yield q, block.ids[near], scores


def top_k(coded: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products among all other rows of coded.

    coded, queries: vec_id, v, norm, as quantized() returns them, in written tables.
    """
    spark = coded.sparkSession
    width = int(coded.agg(F.max(F.size("v"))).first()[0] or 1)
    turn = spark.sparkContext.broadcast(rotation(coded, width))
    longest = coded.orderBy(F.desc("norm"), "vec_id").limit(SEED_ROWS).toPandas()  # a fixed number of the longest vectors
    seeds = spark.sparkContext.broadcast((longest["vec_id"].to_numpy(), _matrix(longest["v"].tolist(), width)))

    def with_floor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k-th best score among the longest vectors: every query's first bound."""
        block = Block(seeds.value[0], seeds.value[1], turn.value)
        for batch in batches:
            if len(batch):
                asked = Block(batch["vec_id"], _matrix(batch["v"].tolist(), width), turn.value)
                floors = np.full(len(batch), -np.inf)
                for q, _, scores in search_block(asked, block, floors, k):
                    if len(scores) >= k:
                        floors[q] = np.sort(scores)[-k]
                floors = floors - SLACK * (1 + np.abs(floors))
                need = np.where(floors > 0, floors / np.maximum(asked.length, 1e-300), 0.0)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "floor": floors, "need": need})

    def query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(b, QUERY_BLOCK)
                data = [np.array(values(part, "vec_id"), np.int64).tobytes(), _matrix(values(part, "v"), width).tobytes(), np.array(values(part, "floor")).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([min(values(part, "need"))]), pa.array([part.num_rows], pa.int32()), *(pa.array([x]) for x in data)], names=["need", "rows", "ids", "vectors", "floors"])

    floored = stored(queries.select("vec_id", "v").mapInPandas(with_floor, "vec_id long, v array<long>, floor double, need double"), "queries")
    asked = floored.repartitionByRange("need", "vec_id").sortWithinPartitions("need", "vec_id").mapInArrow(query_blocks, "need double, rows int, ids binary, vectors binary, floors binary")
    asked = stored(asked.withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    least = asked.select("need", "block", "rows").orderBy("need").toPandas()  # a row per QUERY_BLOCK queries
    needs = spark.sparkContext.broadcast((least["need"].to_numpy(), least["block"].to_numpy()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per VECTOR_BLOCK vectors of like length and query block that they may matter to."""
        for batch in batches:
            for b in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(b, VECTOR_BLOCK)
                matrix = _matrix(values(part, "v"), width)
                reach = np.sqrt((matrix.astype(float) ** 2).sum(axis=1).max())
                blocks = needs.value[1][: np.searchsorted(needs.value[0], reach, "right")]
                ids, data = np.array(values(part, "vec_id"), np.int64).tobytes(), matrix.tobytes()
                for c in range(0, len(blocks), 8):
                    some = blocks[c : c + 8]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), zlib.crc32(ids) % SALT)), pa.array([ids] * len(some)), pa.array([data] * len(some))], names=["block", "salt", "ids", "vectors"])

    sorted_vectors = coded.select("vec_id", "v", "norm").repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    packs = sorted_vectors.select("vec_id", "v").mapInArrow(packed, "block long, salt long, ids binary, vectors binary")
    of_query = asked.select("block", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), "floors")
    if int(least["rows"].sum()) * 8 * (width + 2) <= MAX_SENT:  # vectors stay where they are
        met = packs.join(F.broadcast(of_query), "block")
    else:  # a query block goes to SALT tasks, each of which gets a share of the vectors
        met = packs.join(of_query.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["block", "salt"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vectors, query_ids, query_vectors, floors, number = (batch.column(i)[row].as_py() for i in range(6))
                block = Block(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, width), turn.value)
                mine = Block(np.frombuffer(query_ids, np.int64), np.frombuffer(query_vectors, np.int64).reshape(-1, width), turn.value)
                got = [(np.full(len(found), number), np.full(len(found), mine.ids[q]), np.full(len(found), q), found, scores) for q, found, scores in search_block(mine, block, np.frombuffer(floors), k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[i] for g in got])) for i in range(5)], names=["block", "query_id", "row", "vec_id", "score"])

    found = met.select("ids", "vectors", "query_ids", "query_vectors", "floors", "block").mapInArrow(search, "block long, query_id long, row long, vec_id long, score long")
    by_score = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    coded = stored(quantized(vectors), "vectors")
    return top_k(coded, coded.where(F.col("vec_id") % every == 0), k)
