"""Operator 4: exact top-k inner products by MaxScore over the components of vectors.

A component is a term, a vector's scaled component its posting. The vectors are dealt into shards of bounded size, and
every query is sent to each shard, where it meets the vectors block by block. Its terms are split by their largest
possible contributions in a block: the lists whose bounds together stay under the k-th score so far are non-essential.
Vectors in an essential list are scored on those terms; the rest are probed, largest bound first, for as long as a
vector can still compete. While the k-th score is zero or less every vector is scored, since one in no essential list
can reach it. The shards' lists are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

SCALE = 1024
#: Components of a shard (of 8 bytes in a task's memory); vectors of a block and components it may be padded to.
SHARD_CELLS, VECTOR_BLOCK, BLOCK_CELLS = 2**24, 2048, 2**21
_LONG = 2**63 - 1


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their scaled components padded with zeros)."""
    n = len(column)
    column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bad = np.bincount(row[~np.isfinite(flat)], minlength=n) > 0 if n else np.zeros(0, bool)
    out = np.zeros((n, int(sizes.max(initial=0))))
    with np.errstate(over="ignore", invalid="ignore"):
        out[row, at] = np.floor(float(SCALE) * flat)
    good = ~bad & column.is_valid().to_numpy(zero_copy_only=False)
    return good, out


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[-1] == width else np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, width - x.shape[-1])])


class _Best:
    """The k best of a query so far: scores falling, then ids rising."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0), np.zeros(0, np.int64)

    @property
    def bar(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def _score_block(q: np.ndarray, x: np.ndarray, high: np.ndarray, low: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the block's vectors that reach ``bar``; high, low: the block's extreme components."""
    if bar <= 0:  # scores up to zero reach it, which no list holds
        score = x @ q
        rows = np.flatnonzero(score >= bar)
        return rows, score[rows]
    bound = np.maximum(np.maximum(q * high, q * low), 0)
    order = np.argsort(bound, kind="stable")
    sums = np.cumsum(bound[order])
    split = int(np.searchsorted(sums, bar, "left"))  # lists before it are non-essential
    if split == len(order):
        return np.zeros(0, np.int64), np.zeros(0)
    essential, others = order[split:], order[:split][::-1]
    part = x[:, essential]
    listed = ((part * np.sign(q[essential])) > 0).any(axis=1)
    score = part @ q[essential]
    left = float(sums[split - 1]) if split else 0.0
    rows = np.flatnonzero(listed & (score + left >= bar))
    score = score[rows]
    for at in range(0, len(others), 8):
        some = others[at : at + 8]
        score = score + x[np.ix_(rows, some)] @ q[some]
        left = float(bound[others[at + 8 :]].sum())
        stay = score + left >= bar
        rows, score = rows[stay], score[stay]
    return rows, score


class _Shard:
    """The vectors of a shard in blocks, each with its extreme components."""

    def __init__(self):
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, vectors: pa.ListArray) -> None:
        for at, some in _blocks(vectors):
            good, x = _matrix(some)
            if good.any():
                x = x[good]
                self.blocks.append((ids.slice(at, len(some)).to_numpy()[good], x, x.max(axis=0, initial=-np.inf), x.min(axis=0, initial=np.inf)))

    def answer(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[_Best]:
        best = [_Best(k) for _ in own]
        for ids, x, high, low in self.blocks:
            width = max(x.shape[1], queries.shape[1])
            wide, high, low = _widen(x, width), _widen(high, width), _widen(low, width)
            for q, itself, top in zip(_widen(queries, width), own, best):
                hits, score = _score_block(q, wide, high, low, top.bar)
                other = ids[hits] != itself
                if other.any():
                    top.add(score[other], ids[hits][other])
        return best


def _blocks(vectors: pa.ListArray) -> Iterator[tuple[int, pa.ListArray]]:
    """(start, vectors) of at most VECTOR_BLOCK rows that padding makes no wider than BLOCK_CELLS in all."""
    sizes = np.diff(vectors.offsets.to_numpy())
    at = 0
    while at < len(vectors):
        widest = np.maximum.accumulate(sizes[at : at + VECTOR_BLOCK])
        n = max(int(np.count_nonzero(widest * np.arange(1, len(widest) + 1) <= BLOCK_CELLS)), 1)
        yield at, vectors.slice(at, n)
        at += n


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` best among the rows with other ids.

    A row whose vector or id is null, or whose vector holds a null or non-finite component, takes no part; an empty
    vector scores 0. Missing components of shorter vectors count as zero. Ties go to the smaller id. Repeated
    candidates are candidates each, a repeated query is answered each time. Scores beyond a long are held at its
    limits; scores are exact while the sums stay under 2^53. Fewer candidates than ``k`` give fewer rows. Other
    columns, whatever their names, are left out; an empty table or no query gives no rows.

    The driver gets three numbers. Vectors are shuffled once, queries once for each shard; a task holds a shard of
    SHARD_CELLS components and answers the queries as they come, with k rows for each.
    """
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("vec_id is not null and vector is not null")
    count, n_asked, cells = rows.agg(F.count("*"), F.count_if("asked"), F.sum(F.size("vector"))).first()
    schema = "query bigint, query_id bigint, vec_id bigint, score bigint"
    spark = vectors.sparkSession
    # Shards fill the cores of a small input; the result does not depend on their number.
    shards = max(-(-(cells or 0) // SHARD_CELLS), min(spark.sparkContext.defaultParallelism, count), 1)
    queries, _ = materialise(rows.where("asked").select("vec_id", "vector").withColumn("query", F.monotonically_increasing_id()), "queries")
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query", "vec_id", "vector")
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("bigint").alias("query"), "vec_id", "vector")
    met = dealt.unionByName(sent).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current = _Shard(), None
        for batch in batches:
            number, asked = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(asked.astype(int)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                if number[a] != current:
                    shard, current = _Shard(), number[a]
                some = batch.slice(a, b - a)
                if not asked[a]:
                    shard.add(some.column(2), some.column(3))
                    continue
                for at, vectors in _blocks(some.column(3)):
                    good, q = _matrix(vectors)
                    own, query = (some.column(c).slice(at, len(vectors)).to_numpy()[good] for c in (2, 1))
                    best = shard.answer(own, q[good], k)
                    sizes = [len(b.id) for b in best]
                    if sum(sizes):
                        score = np.concatenate([b.score for b in best])
                        score = pa.array([int(min(max(s, -_LONG - 1), _LONG)) for s in score.tolist()], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, sizes)), pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([b.id for b in best])), score], names=["query", "query_id", "vec_id", "score"])

    found = met.mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
