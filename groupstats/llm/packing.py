"""Packing of tokenised documents into sequences of a fixed length by cutting-stock column generation.

1. A document's ids, with a closing id, are cut into full sequences and a rest below ``length``.
2. Rests are rounded up to size classes (``length / CLASSES`` ids wide) and counted: a histogram of at most
   ``CLASSES`` numbers, which is all that reaches the driver.
3. A linear program over patterns (how many rests of each class share a sequence) is solved by column
   generation: the simplex basis prices classes, a knapsack dynamic program over the sequence finds the
   pattern that is worth most at these prices, until none is worth more than a sequence. Rounding down its
   solution leaves fewer rests than the basis has patterns times their sizes; these are packed best fit,
   largest first, class by class.
4. Rests are ranked inside their class, by hash buckets and running counts, so a class may hold any share of
   the rows; a small table of pattern slots maps a class and rank to a sequence. Offsets are running lengths
   inside a sequence, which holds at most ``CLASSES`` rests.

A sequence is padded to ``length`` unless its ids number a power of two. NULL texts are empty: only the
closing id. Repeated rows are packed like any others; rows with the same doc_id are told apart by the
text, and of two equal rows each gets its own place.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from groupstats.llm.batches import map_batches, whole_text
from groupstats.llm.word_model import load_words
from groupstats.session import shared_folder

CLASSES = 256
RANK_BUCKETS = 64
#: Text bytes that one step of a task tokenises.
STEP_BYTES = 1 << 18

_PIECE = StructType(
    [
        StructField("start", LongType()),
        StructField("length", LongType()),
        StructField("ids_crc32", LongType()),
        StructField("doc_tokens", LongType()),
    ]
)


def cut_pieces(df: DataFrame, tokenizer: str, length: int, closing_id: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document: its id, start, length, CRC-32 of the ids, and the document's ids."""
    rows = df.select(F.col(id_column), whole_text(text).alias("_text"))
    added = StructType([StructField("pieces", ArrayType(_PIECE))])

    def work(part: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, counts = load_words(tokenizer).encode(part.column("_text").to_pylist())
        ends = np.cumsum(counts)
        flat = np.insert(ids.astype("<u4"), ends, closing_id)
        sizes = counts + 1
        ends = np.cumsum(sizes)
        per_doc = -(-sizes // length)
        rows: list[tuple[int, int, int, int]] = []
        for end, size in zip(ends.tolist(), sizes.tolist()):
            for start in range(0, size, length):
                stop = min(start + length, size)
                rows.append((start, stop - start, zlib.crc32(flat[end - size + start : end - size + stop]), size))
        table = np.array(rows, np.int64).reshape(-1, 4)
        pieces = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(4)], [f.name for f in _PIECE.fields])
        offsets = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
        return {"pieces": pa.ListArray.from_arrays(pa.array(offsets), pieces)}

    made = map_batches(rows, "_text", work, added, drop=("_text",), limit=STEP_BYTES, tables=True)
    return made.select(F.col(id_column), F.explode("pieces").alias("p")).select(id_column, "p.*")


# ------------------------------------------------------------------ patterns


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1..capacity that fits: an unbounded knapsack by dynamic program."""
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        values = prices[:room] + value[room - 1 :: -1][:room]
        k = int(np.argmax(values))
        value[room], choice[room] = (values[k], k + 1) if values[k] > value[room - 1] else (value[room - 1], 0)
    pattern = np.zeros(capacity, np.int64)
    room = capacity
    while room > 0:
        size = int(choice[room])
        if size == 0:
            room -= 1
            continue
        pattern[size - 1] += 1
        room -= size
    return float(value[capacity]), pattern


def solve_patterns(demand: np.ndarray, capacity: int, steps: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, covering ``demand[s - 1]`` rests of every size s exactly.

    Revised simplex on the linear program; ``steps`` bounds the columns generated (an early stop only costs
    padding, every rest is still placed).
    """
    wanted = np.flatnonzero(demand)
    if not len(wanted):
        return []
    m = len(wanted)
    basis = np.zeros((m, m))
    for row, size in enumerate(wanted + 1):
        basis[row, row] = capacity // size
    inverse = np.linalg.inv(basis)
    need = demand[wanted].astype(float)
    use = inverse @ need
    for step in range(steps):
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        prices = np.full(capacity, -1.0)
        prices[wanted] = duals
        worth, pattern = best_pattern(np.maximum(prices, 0) * (prices > 0), capacity)
        if worth <= 1 + 1e-7:
            break
        column = pattern[wanted].astype(float)
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratios))
        if not np.isfinite(ratios[leave]):
            break
        step_size = max(ratios[leave], 0.0)
        use = use - step_size * direction
        use[leave] = step_size
        basis[:, leave] = column
        pivot = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, pivot)
        inverse[leave] = pivot
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
            use = np.maximum(inverse @ need, 0)
    left = demand.copy()
    plan: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-use):
        pattern = np.zeros(capacity, np.int64)
        pattern[wanted] = np.rint(basis[:, k]).astype(np.int64)
        inside = pattern > 0
        if not inside.any():
            continue
        times = int(min(np.floor(use[k] + 1e-6), (left[inside] // pattern[inside]).min()))
        if times > 0:
            plan.append((pattern, times))
            left = left - times * pattern
    return plan + pack_left(left, capacity)


def pack_left(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit, largest first, over the sizes still to place, one sequence pattern at a time."""
    left = left.copy()
    made: Counter = Counter()
    while left.any():
        pattern, room = np.zeros(capacity, np.int64), capacity
        for size in np.flatnonzero(left)[::-1] + 1:
            count = min(int(left[size - 1]), room // int(size))
            pattern[size - 1] = count
            room -= count * int(size)
        inside = pattern > 0
        times = int((left[inside] // pattern[inside]).min())
        left = left - times * pattern
        made[tuple(pattern.tolist())] += times
    return [(np.array(p, np.int64), n) for p, n in made.items()]


def pattern_slots(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(size, first rank, past rank, rests a sequence, first sequence)``: who goes where, by size and rank."""
    rows, ranks, sequence = [], Counter(), 0
    for pattern, times in plan:
        for size in np.flatnonzero(pattern) + 1:
            each = int(pattern[size - 1])
            first = ranks[size]
            ranks[size] += each * times
            rows.append((int(size), first, ranks[size], each, sequence))
        sequence += times
    return rows


# ------------------------------------------------------------------- packing


def pack(df: DataFrame, tokenizer: str, length: int = 4096, closing_id: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; runs jobs to fit the patterns."""
    if length % CLASSES:
        raise ValueError(f"length must be a multiple of {CLASSES}")
    spark = df.sparkSession
    unit = length // CLASSES
    path = shared_folder(spark, "pieces")
    cut_pieces(df, tokenizer, length, closing_id, id_column, text).withColumn(
        "_class", F.ceil(F.col("length") / unit).cast("int")
    ).withColumn("_bucket", F.pmod(F.xxhash64(id_column, "start"), F.lit(RANK_BUCKETS)).cast("int")).write.parquet(path)
    pieces = spark.read.parquet(path)
    # at most CLASSES x RANK_BUCKETS counts
    counts = pieces.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by(
        [("_class", "ascending"), ("_bucket", "ascending")]
    )
    classes, buckets, n = (counts[c].to_numpy() for c in counts.column_names)
    demand = np.zeros(CLASSES, np.int64)
    np.add.at(demand, classes - 1, n)
    slots = pattern_slots(solve_patterns(demand, CLASSES))
    before = np.cumsum(n) - n
    before -= np.concatenate([[0], np.cumsum(demand)])[classes - 1] if len(n) else 0
    starts = spark.createDataFrame(
        list(zip(classes.tolist(), buckets.tolist(), before.tolist())), "_class int, _bucket int, _before long"
    )
    table = spark.createDataFrame(slots, "_size int, _from long, _to long, _each int, _sequence long")
    order = Window.partitionBy("_class", "_bucket").orderBy(F.col(id_column), "start", "length", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(F.broadcast(starts), ["_class", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(
        F.broadcast(table),
        (F.col("_class") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    ).withColumn("sequence_id", F.col("_sequence") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"),
    )
