"""Exact top-k inner products by columnar branch and bound.

Candidates are held in vertical blocks (one array a dimension), dimensions with the most mass first, with the
norm of what follows each STEP of them, computed once a block. A group of queries takes the first dimensions
as one matrix product; then each query goes on by itself: what remains of a candidate is bounded by the product
of the remaining norms, candidates whose sum and bound can't reach the k-th best so far are compacted away, and
the next dimensions are read for the survivors alone. Scores are integers; they are summed as doubles where no
partial sum can leave the integers that doubles hold, else as 64-bit integers, so results are exact; ties go to
the smaller id.

Queries are taken in blocks of QUERIES vectors: one block is sent to all tasks at a time (its size is fixed),
all candidates are read once for each block, its hits are written and the block is released. Vectors of different
lengths are padded with zeros. Vectors that are null, empty of ids, or hold nulls, NaN or infinities, take no part;
empty vectors score 0. Of rows with equal query ids the first in order of components counts; rows with the query's
id are its own and are left out. Repeated candidates are candidates each. An empty table has no hits. Columns
besides vec_id and embedding are ignored. A vector is held whole; components beyond 2^53 / 1024 aren't exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean

#: Queries sent at once and multiplied at once, candidates in a block, dimensions between bounds.
QUERIES, GROUP, BLOCK, STEP = 4096, 64, 16384, 16
HITS = "query_id long, vec_id long, score long"


def valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _scaled(column: pa.Array, scale: float) -> np.ndarray:
    """Rows of floor(scale * x), padded to the longest."""
    n = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(n), int(n.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


class Block:
    """Candidates by dimension: columns[d] holds component order[d] of all of them."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray):
        mass = columns.astype(np.float64) ** 2
        self.ids, self.order = ids, np.argsort(-mass.sum(axis=1), kind="stable")
        self.columns, mass = columns[self.order], mass[self.order]
        # norms[j]: of the components from j * STEP on
        parts = np.add.reduceat(mass, np.arange(0, max(1, len(mass)), STEP), axis=0) if len(mass) else np.zeros((1, len(ids)))
        self.norms = np.sqrt(np.cumsum(parts[::-1], axis=0)[::-1])
        self.floats = self.columns.astype(np.float64)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: list[int | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row) ids and scores of its k best, of those that reach its floor."""
        queries = queries[:, self.order]
        sizes = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        exact = float(sizes.max(initial=0)) * float(self.norms[0].max(initial=0)) < 2**52
        columns = self.floats if exact else self.columns
        queries = queries.astype(columns.dtype)
        rest = np.stack([np.sqrt((queries[:, at:].astype(np.float64) ** 2).sum(axis=1)) for at in range(STEP, max(STEP, len(columns)) + STEP, STEP)], axis=1)
        for g in range(0, len(queries), GROUP):
            first = queries[g : g + GROUP, :STEP] @ columns[:STEP]
            for i in range(g, min(g + GROUP, len(queries))):
                yield self._one(columns, queries[i], own[i], k, floors[i], first[i - g], rest[i])

    def _one(self, columns: np.ndarray, query: np.ndarray, own: int, k: int, floor: int | None, score: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alive = np.flatnonzero(self.ids != own)
        score = score[alive]
        for j, at in enumerate(range(STEP, len(columns), STEP)):
            bound = rest[j] * self.norms[j + 1][alive] * (1 + 1e-9) + 1
            least = floor
            if floor is None and len(alive) > k:
                least = np.partition(score - bound, len(alive) - k)[len(alive) - k]
            if least is not None:
                stay = score + bound >= least
                alive, score = alive[stay], score[stay]
            score = score + query[at : at + STEP] @ columns[at : at + STEP].take(alive, axis=1)
        if floor is not None:
            alive, score = alive[score >= floor], score[score >= floor]
        if len(score) > k:
            top = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            alive, score = alive[top], score[top]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best].astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[Block]:
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            held.append(b.slice(at, BLOCK))
            n += held[-1].num_rows
            if n >= BLOCK:
                yield _vertical(held, scale)
                held, n = [], 0
    if n:
        yield _vertical(held, scale)


def _vertical(held: list[pa.RecordBatch], scale: float) -> Block:
    t = pa.Table.from_batches(held).combine_chunks()
    column = t.column("embedding").combine_chunks()
    return Block(t.column("vec_id").to_numpy(), np.ascontiguousarray(_scaled(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, scale).T))


def _hits(sent, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(own)
        for block in _blocks(batches, scale):
            wide = max(given.shape[1], len(block.columns))
            queries = np.pad(given, ((0, 0), (0, wide - given.shape[1])))
            if wide > len(block.columns):
                block = Block(block.ids, np.pad(block.columns[np.argsort(block.order)], ((0, wide - len(block.columns)), (0, 0))))
            floors = [int(score[-1]) if len(score) == k else None for _, score in best]
            for i, (got, score) in enumerate(block.search(queries, own, k, floors)):
                got, score = np.concatenate([best[i][0], got]), np.concatenate([best[i][1], score])
                first = np.lexsort((got, -score))[:k]
                best[i] = got[first], score[first]
        if len(own):
            columns = np.repeat(own, [len(ids) for ids, _ in best]), np.concatenate([ids for ids, _ in best]), np.concatenate([score for _, score in best])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    return lean(run)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors(vec_id, embedding) for the rows where is_query holds."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "top-k")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    asked = scratch.save(rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    found = [scratch.save(spark.createDataFrame([], HITS), "none")]
    stream = asked.toLocalIterator()
    while block := list(islice(stream, QUERIES)):
        given = _scaled(pa.array([r.embedding for r in block], pa.list_(pa.float64())), scale)
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in block], np.int64), given))
        found.append(scratch.save(rows.mapInArrow(_hits(sent, k, scale), HITS), f"hits{len(found)}"))
        sent.unpersist()
    hits = spark.read.schema(HITS).parquet(*[scratch.path(name) for name in ("none", *[f"hits{i}" for i in range(1, len(found))])])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
