"""Exact k best inner products by pivot-table elimination.

Every vector is stored with its distances to a few pivots.  For a query the largest difference of
pivot distances is a lower bound of the distance, hence with both norms an upper bound of the inner
product.  A task evaluates its vectors in the order of that bound and stops for a query once the next
bound lies below its k-th score.  Queries reach the tasks in blocks of bounded size.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.workspace import Workspace

PIVOTS = 32
#: Vectors that pivots are chosen from, by hash order; the choice affects speed only.
PIVOT_SAMPLE = 2048
QUERY_BLOCK = 2048
_FIRST, _TILE = 64, 4_000_000


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """``id, v``: components as floor(scale * x).  Rows without an id, and vectors that are null or hold
    null or non-finite components, are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return kept.select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(column), width)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other: each next one has the largest distance to those chosen."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    sample = sample.astype(np.float64)
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _with_distances(batches, pivots: np.ndarray):
    for batch in batches:
        v = _matrix(batch.column(1), pivots.shape[1], np.int64)
        d = pivot_distances(v, pivots)
        offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
        table = pa.ListArray.from_arrays(offsets, pa.array(d.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, table], names=["id", "v", "pivot_distance"])


class QueryBlock:
    """Queries with the best candidates that a task has met so far."""

    def __init__(self, ids: list, vectors: np.ndarray, pivots: np.ndarray, k: int):
        self.ids = np.array(ids)
        self.vectors, self.k = vectors, k
        self.distances = pivot_distances(vectors, pivots)
        self.norms = (vectors.astype(np.float64) ** 2).sum(axis=1)

    def start(self) -> None:
        self.best: list[tuple[np.ndarray, np.ndarray]] = [
            (np.zeros(0, np.int64), np.zeros(0, self.ids.dtype)) for _ in self.ids
        ]

    def bounds(self, some: slice, distances: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products; a little too high, never too low."""
        low = np.abs(np.sqrt(self.norms[some])[:, None] - np.sqrt(norms))
        for p in range(distances.shape[1]):
            np.maximum(low, np.abs(self.distances[some, p, None] - distances[:, p]), out=low)
        both = self.norms[some][:, None] + norms
        return (both - low * low) / 2 + 1e-6 + 1e-9 * both

    def meet(self, ids: np.ndarray, vectors: np.ndarray, distances: np.ndarray) -> None:
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        largest = max(np.abs(vectors).max(initial=0), np.abs(self.vectors).max(initial=0))
        exact = np.float64 if vectors.shape[1] * float(largest) ** 2 < 2**53 else np.int64
        x, q = vectors.astype(exact), self.vectors.astype(exact)
        step = max(1, _TILE // max(1, len(ids)))
        for at in range(0, len(self.ids), step):
            upper = self.bounds(slice(at, at + step), distances, norms)
            for row, bound in enumerate(upper, start=at):
                self._one(row, bound, ids, x, q[row])

    def _one(self, row: int, bound: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray) -> None:
        scores, names = self.best[row]
        open_ = np.flatnonzero(ids != self.ids[row])
        if len(scores) == self.k:
            open_ = open_[bound[open_] >= scores[-1]]
        order = open_[np.argsort(-bound[open_], kind="stable")]
        at, many = 0, _FIRST
        while at < len(order) and not (len(scores) == self.k and bound[order[at]] < scores[-1]):
            some = order[at : at + many]
            scores = np.concatenate([scores, (x[some] @ q).astype(np.int64)])
            names = np.concatenate([names, ids[some]])
            top = np.lexsort((names, -scores))[: self.k]
            scores, names = scores[top], names[top]
            at, many = at + many, many * 2
        self.best[row] = scores, names


def _search(batches, block: QueryBlock, numbers: np.ndarray):
    block.start()
    width, pivots = block.vectors.shape[1], block.distances.shape[1]
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        block.meet(ids, _matrix(batch.column(1), width, np.int64), _matrix(batch.column(2), pivots, np.float64))
    many = [len(s) for s, _ in block.best]
    if sum(many):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(numbers, many), pa.int64()),
                pa.array(np.repeat(block.ids, many)),
                pa.array(np.concatenate([n for _, n in block.best])),
                pa.array(np.concatenate([s for s, _ in block.best]), pa.int64()),
            ],
            names=["query", "query_id", "id", "score"],
        )


def top_k(vectors: DataFrame, is_query, k: int = 5, workspace: Workspace | None = None) -> DataFrame:
    """The ``k`` best of all rows ``id long, v array<long>`` for every distinct row with ``is_query``.

    Returns ``query_id, rank, id, score``.  Rows with a query's own id are no candidates of it; equal
    scores go to the smaller id; only vectors of equal length are compared.  Scores must fit a long.
    """
    spark = vectors.sparkSession
    workspace = workspace or Workspace(spark, "topk")
    found = spark.createDataFrame([], "query long, query_id long, id long, score long")
    lengths = sorted(r[0] for r in vectors.select(F.size("v")).distinct().collect())
    for width in lengths:
        same = vectors.where(F.size("v") == width)
        order = F.xxhash64("id", "v")
        sample = same.orderBy(order).limit(PIVOT_SAMPLE).select("v").collect()
        pivots = choose_pivots(np.array([r[0] for r in sample], dtype=np.int64).reshape(len(sample), width))
        step = partial(_with_distances, pivots=pivots)
        indexed = map_arrow(same, step, "id long, v array<long>, pivot_distance array<double>")
        indexed = workspace.save(indexed, f"pivots-{width}")
        queries = indexed.where(is_query).select("id", "v").distinct()
        blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        for b in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).collect()
            if not rows:
                continue
            matrix = np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), width)
            block = QueryBlock([r["id"] for r in rows], matrix, pivots, k)
            numbers = (np.arange(len(rows), dtype=np.int64) * blocks + b) * len(lengths) + lengths.index(width)
            run = partial(_search, block=block, numbers=numbers)
            found = found.union(map_arrow(indexed, run, "query long, query_id long, id long, score long"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
