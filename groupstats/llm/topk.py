"""Exact top-k inner products by no-random-access aggregation of sorted lists, in blocks.

Vectors of integers are kept in blocks, one list per dimension, sorted by component. For a query, a list is read
from the end at which its components add most, all lists in step. Of every vector, the part of the score seen so far
bounds the score from below (what is unseen adds at least the list's last value) and from above (at most the value
the list has come to). Reading stops when few vectors can reach the k best lower bounds; those left are resolved to
their full scores, ties going to the smaller id. The bounds of all queries of a block are worked out together, as products
of the weights with the part of the block that has been read; the k-th best score goes on to the next block.

Query blocks and candidate blocks form a grid, and each of its cells is a key of its own: a task holds a query block and a
few candidate blocks. What leaves a block are about k rows per query, so the shuffle to pick the final k holds k rows
per query and block.

Vectors that are NULL, hold NULL or non-finite components, or have no id take no part; vectors are compared with those of
the same length. Rows that share a query's id are not its candidates. Repeated rows are candidates each on its own; other
columns are not looked at, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
QUERY_BLOCK = 512
#: Candidate blocks of a cell of the grid.
CELL_BLOCKS = 4
#: Lists are read to the n-th part of their length, step by step.
SHARES = (8, 2, 1)
#: A query whose candidates left are at most this part of the block is resolved.
RESOLVED = 16
#: Pairs whose full scores are worked out at once.
PAIRS = 1 << 16

_BLOCK = "dim int, ids binary, vectors binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, NULL if the vector cannot take part."""
    good = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def blocks(df: DataFrame, id_column: str, vector: str, size: int) -> DataFrame:
    """One row per block of up to ``size`` rows of a task: ids and vectors as packed longs, by vector length."""

    def pack(ids: list[np.ndarray], vectors: list[np.ndarray], dim: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(vectors).tobytes()])],
            ["dim", "ids", "vectors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                matrix = flat[(starts[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
                for at in range(0, len(rows), size):
                    part = rows[at : at + size]
                    kept, vectors, n = held.pop(dim, ([], [], 0))
                    if n + len(part) > size:
                        yield pack(kept, vectors, dim)
                        kept, vectors, n = [], [], 0
                    held[dim] = ([*kept, ids[part]], [*vectors, matrix[at : at + size].ravel()], n + len(part))
        for dim, (kept, vectors, _) in held.items():
            yield pack(kept, vectors, dim)

    return df.select(F.col(id_column).cast("long"), F.col(vector)).mapInArrow(run, _BLOCK)


class SortedLists:
    """A block's components by dimension, and each component's place in its list from either end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, vectors
        self.values = vectors.astype(np.float64)
        order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, order, 0)
        self.from_least = np.empty(order.shape, np.int32)
        np.put_along_axis(self.from_least, order, np.arange(len(order), dtype=np.int32)[:, None], 0)
        self.size = np.abs(self.values).max(initial=0.0)

    def top(self, queries: np.ndarray, own: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, places of candidates and scores: every candidate that can be among the ``k`` best of a query.

        ``bars`` are the ``k``-th best scores of the queries so far, and are raised to those of this block.
        """
        n, dims = self.values.shape
        going = np.arange(len(queries))
        found = []
        for share in SHARES:
            if not len(going):
                break
            depth = max(1, -(-n // share))
            q = queries[going].astype(np.float64)
            lower, upper = np.zeros((len(q), n)), np.zeros((len(q), n))
            # positive weights read a list from its greatest value on, negative ones from its least
            for weight, read, front, last in (
                (np.maximum(q, 0), self.from_least >= n - depth, self.sorted[n - depth], self.sorted[0]),
                (np.minimum(q, 0), self.from_least < depth, self.sorted[depth - 1], self.sorted[-1]),
            ):
                # what is unseen adds at most the value a list has come to, at least its last one
                upper += weight @ np.where(read, self.values - front, 0.0).T + (weight @ front)[:, None]
                lower += weight @ np.where(read, self.values - last, 0.0).T + (weight @ last)[:, None]
            mine = self.ids[None, :] == own[going][:, None]
            lower[mine], upper[mine] = -np.inf, -np.inf
            slack = 1e-12 * (np.abs(q).sum(axis=1) * self.size + 1)
            if n >= k:
                reached = np.partition(lower, n - k, axis=1)[:, n - k] - slack
                bars[going] = np.maximum(bars[going], reached)
            alive = upper + slack[:, None] >= bars[going][:, None]
            alive &= ~mine
            few = alive.sum(axis=1) <= (n if depth == n else max(k, n // RESOLVED))
            rows, places = np.nonzero(alive & few[:, None])
            numbers = going[rows]
            scores = np.empty(len(numbers), np.int64)
            for at in range(0, len(numbers), PAIRS):
                some = slice(at, at + PAIRS)
                scores[some] = (queries[numbers[some]] * self.exact[places[some]]).sum(axis=1)
            found.append((numbers, places, scores))
            going = going[~few]
        return tuple(np.concatenate(part) for part in zip(*found))  # there is always a first step


def best_of(numbers: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, numbers))
    sorted_numbers = numbers[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_numbers, sorted_numbers, side="left")
    return order[rank < k]


def top_k(df: DataFrame, queries: Column, id_column: str, vector: str, k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows for every row for which ``queries`` holds.

    A query id that several rows have takes the least of their vectors.
    """
    rows = df.select(F.col(id_column), quantised(F.col(vector), scale).alias("_v")).filter(
        F.col("_v").isNotNull() & F.col(id_column).isNotNull()
    )
    asked = rows.filter(queries).groupBy(id_column).agg(F.min("_v").alias("_v"))
    every = rows.count()
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    stripes = max(1, -(-every // (BLOCK * CELL_BLOCKS)))
    asked = blocks(asked.repartition(parts), id_column, "_v", QUERY_BLOCK)
    asked = asked.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors", "dim": "q_dim"})
    held = blocks(rows, id_column, "_v", BLOCK)
    # a grid of cells: every query block meets every candidate block in the one cell of their part and stripe
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
    cells = min(parts * stripes, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = held.select("*", number("ids", stripes).alias("_stripe"), each(parts).alias("_part"))
    asked = asked.select("*", number("q_ids", parts).alias("_part"), each(stripes).alias("_stripe"))
    key = ["_part", "_stripe"]
    pairs = asked.repartition(cells, *key).hint("merge").join(held.repartition(cells, *key), key)
    pairs = pairs.sortWithinPartitions(*key, "q_ids").select("q_dim", "q_ids", "q_vectors", "dim", "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, SortedLists] = {}
        asking: tuple[bytes, np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                q_dim, q_ids, q_vectors, dim, ids, vectors = (batch.column(c)[row].as_py() for c in range(6))
                if q_dim != dim:
                    continue
                if asking is None or asking[0] != q_ids:
                    own = np.frombuffer(q_ids, np.int64)
                    asking = q_ids, own, np.frombuffer(q_vectors, np.int64).reshape(len(own), dim), np.full(len(own), -np.inf)
                mark = hash(ids)
                if mark not in known:
                    if len(known) >= CELL_BLOCKS:
                        known.clear()
                    numbers = np.frombuffer(ids, np.int64)
                    known[mark] = SortedLists(numbers, np.frombuffer(vectors, np.int64).reshape(len(numbers), dim))
                lists = known[mark]
                _, own, asked_vectors, bars = asking
                which, places, scores = lists.top(asked_vectors, own, bars, k)
                best = best_of(which, lists.ids[places], scores, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[which[best]]), pa.array(lists.ids[places[best]]), pa.array(scores[best])],
                    ["query_id", "vec_id", "score"],
                )

    best = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
