"""Exact top-k search by inner product, in tiles.

Queries are taken in blocks of a bounded size, each broadcast once its size is known; candidates stay
where they are. A task meets its shard of the candidates batch by batch with tiles of the queries: a
dense matrix product, from which what can still reach a query's k best is selected. Each task sends one
list of at most k rows for each query, and the lists are merged in a tree of `fan` lists at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwatch.functions.shared import stage

BLOCK_BYTES = 16 << 20
TILE_ROWS = 256
SHARD_ROWS = 4096
FAN = 8
# Beyond this bound a sum of products may not be exact in a double.
EXACT = float(1 << 53)
LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, cells): floor(scale * x) of each component, as doubles, for every row.

    Rows whose id or vector is null, or that hold a null, NaN or infinite component, are left out.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf"))
    )
    cells = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & sound).select("vec_id", cells.alias("cells"))


def numbered(cells: DataFrame) -> DataFrame:
    """`cells` (vec_id, cells) written once, with a number that is each row's own."""
    rows = cells.select(F.col("vec_id").cast("long").alias("vec_id"), "cells", F.monotonically_increasing_id().alias("row"))
    return stage(rows, "vectors", spread=True)


def _matrix(cells: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    lists = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    lengths = np.diff(lists.offsets.to_numpy())
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).dot(whole(b).T) if width else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class _Lists:
    """The k best (score, vec_id) of every query of a block so far; places that are not filled yet come last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.full = np.zeros((queries, k), bool)
        self.scores = np.full((queries, k), LEAST, np.int64)
        self.ids = np.zeros((queries, k), np.int64)

    def add(self, first: int, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """Bring in a tile: `scores` (queries from `first`, candidates), those that are `valid`."""
        rows = slice(first, first + len(scores))
        # The k-th score of the tile and the one held before are both bounds from below.
        least = np.where(self.full[rows, -1], self.scores[rows, -1], LEAST)
        if scores.shape[1] > self.k:
            shown = np.where(valid, scores, LEAST)
            own = np.partition(shown, -self.k, axis=1)[:, -self.k]
            least = np.maximum(least, own)
        query, candidate = np.nonzero(valid & (scores >= least[:, None]))
        touched = np.unique(query)
        if not len(touched):
            return
        query = np.concatenate([query, np.repeat(touched, self.k)])
        score = np.concatenate([scores[query[: len(candidate)], candidate], self.scores[rows][touched].ravel()])
        vec_id = np.concatenate([ids[candidate], self.ids[rows][touched].ravel()])
        full = np.concatenate([np.ones(len(candidate), bool), self.full[rows][touched].ravel()])
        order = np.lexsort((vec_id, -(score + (score == LEAST)), ~full, query))
        chosen = order[np.searchsorted(query[order], touched)[:, None] + np.arange(self.k)]
        at = first + touched
        self.scores[at], self.ids[at], self.full[at] = score[chosen], vec_id[chosen], full[chosen]


LISTS = "query long, query_id long, vec_id long, score long, shard int"


def _block_lists(block: DataFrame, candidates: DataFrame, k: int, shards: int) -> DataFrame:
    """One list for each query of a bounded block and each task over the candidates."""
    table = block.toArrow()
    plain = (table.column("row").to_numpy(), table.column("vec_id").to_numpy(), _matrix(table.column("cells")))
    shared = block.sparkSession.sparkContext.broadcast(plain)

    def search(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, query_id, queries = shared.value
        by_row = np.argsort(row)
        best = _Lists(len(row), k)
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_ROWS):
                some = batch.slice(start, SHARD_ROWS)
                ids, numbers = some.column(0).to_numpy(), some.column(2).to_numpy()
                matrix = _matrix(some.column(1))
                # A query is no candidate of its own.
                place = np.minimum(np.searchsorted(row, numbers, sorter=by_row), max(len(row) - 1, 0))
                own = by_row[place] if len(row) else place
                mine = np.where(row[own] == numbers, own, -1) if len(row) else np.full(len(numbers), -1)
                for first in range(0, len(row), TILE_ROWS):
                    score = _products(queries[first : first + TILE_ROWS], matrix)
                    valid = np.arange(first, first + len(score))[:, None] != mine
                    best.add(first, score, valid, ids)
        query, nth = np.nonzero(best.full)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row[query]),
                pa.array(query_id[query]),
                pa.array(best.ids[query, nth]),
                pa.array(best.scores[query, nth]),
                pa.array(np.full(len(query), TaskContext.get().partitionId() % shards, np.int32)),
            ],
            ["query", "query_id", "vec_id", "score", "shard"],
        )

    return candidates.select("vec_id", "cells", "row").mapInArrow(search, LISTS)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, fan: int = FAN) -> DataFrame:
    """The k candidates with the highest inner product for each query: query_id, rank, vec_id, score.

    Both tables hold (vec_id, cells, row) of `numbered`. A query's own row is no match; other rows that repeat
    its id are, and every row that repeats an id is a candidate, or a query with ranks, of its own. Ties
    go to the smaller id. Vectors of different lengths are compared over the longer one, filled up with
    zeros. A score beyond 64 bits is held at the limit. Empty tables give an empty result.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("width")).first()
    held = size["n"] * (8 * max(size["width"] or 0, 1) + 16 + 17 * k)
    blocks = math.ceil(held / BLOCK_BYTES) or 1
    # Rows are numbered in order within each file, so that a remainder takes an even share.
    parts = [queries.where(F.pmod(F.col("row"), F.lit(blocks)) == b) for b in range(blocks)]
    shards = max(candidates.rdd.getNumPartitions(), 1)
    lists = reduce(DataFrame.unionByName, [_block_lists(part, candidates, k, shards) for part in parts])
    while True:
        by = Window.partitionBy("query", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("shard", (F.col("shard") / fan).cast("int")) if shards > 1 else lists.withColumn("shard", F.lit(0))
        shards = math.ceil(shards / fan)
        lists = lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def search_embeddings(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """`top_k` with the rows whose id is divisible by `every` as queries, against all rows."""
    cells = numbered(quantised(vectors))
    return top_k(cells.where(F.col("vec_id") % every == 0), cells, k)
