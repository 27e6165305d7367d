"""Group work that stays balanced when one key holds a large share of all rows.

``find_heavy`` sketches the frequent keys and keeps those above
``spark.groupstats.heavyRows``, largest first and at most
``spark.groupstats.maxHeavy`` of them. That limit is what bounds every
broadcast below. Keys beyond it are still processed: they take the ordinary
shuffle path, where none of them can hold more than about
1/5,000 of the rows. :func:`split` cuts a table once for a chain of operators.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupstats.session import HEAVY_ROWS, MAX_HEAVY, SMALL_ROWS, cut_lineage, setting, stored

SKETCH_LEAST, SKETCH_MOST = 4096, 20_000  # counters of a sketch
HASH_PREFIX = 4  # hex digits: 65,536 equal hash ranges
PAST_LAST = "g"  # sorts after every hex digest


def as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def all_present(keys: Sequence[str]) -> Column:
    """True where no key column is NULL."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """NULL-safe match of ``keys`` on the left with ``_key_<k>`` on the right."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_key_{k}"]) for k in keys])


def _prefixed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_key_{k}" for k in keys})


# ---------------------------------------------------------------- heavy keys


@dataclass(frozen=True)
class Heavy:
    """Keys too large for one task; ``rows`` is a local table or None."""

    keys: tuple[str, ...]
    rows: DataFrame | None


def _key_hash(keys: Sequence[str]) -> Column:
    """A number for each key, NULL keys included."""
    return F.xxhash64(*keys, *[F.col(k).isNull() for k in keys])


def find_heavy(df: DataFrame, keys: str | Sequence[str]) -> Heavy:
    """Find the heavy keys of ``df``.

    One pass sketches the frequent keys: every task keeps ``maxHeavy`` counters, but at least 4,096 and at most 20,000; the
    sketches are merged, and no rows are shuffled. A key is sure to be found if it holds more than ``heavyRows`` rows and more
    than the sketch's error, some 4 rows in as many as there are counters; others take the ordinary path. Only if the sketch shows some key above ``heavyRows`` is the
    table read again, to count the rows of such keys exactly.

    ``df`` may be a narrower table whose counts per key are at least those of
    the table to be processed, for example the base table before its joins.
    """
    keys = as_list(keys)
    spark = df.sparkSession
    limit, most = setting(spark, HEAVY_ROWS), setting(spark, MAX_HEAVY)
    tracked = min(max(most, SKETCH_LEAST), SKETCH_MOST)
    sketch = df.select(_key_hash(keys).alias("_key_hash")).agg(
        F.expr(f"approx_top_k(_key_hash, {tracked}, {tracked})").alias("top")
    )
    frequent = sketch.select(F.explode("top").alias("t")).select("t.item", "t.count").filter(F.col("count") > limit)
    hashes = frequent.select("item").toArrow()  # at most maxHeavy
    if not hashes.num_rows:
        return Heavy(tuple(keys), None)
    listed = F.broadcast(spark.createDataFrame(hashes, "item long"))
    sizes = df.join(listed, _key_hash(keys) == F.col("item"), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest = sizes.filter(F.col("_rows") > limit).orderBy(F.desc("_rows")).limit(most).select(*keys).toArrow()
    rows = spark.createDataFrame(largest, sizes.select(*keys).schema) if largest.num_rows else None
    return Heavy(tuple(keys), rows)


def split_heavy(df: DataFrame, heavy: Heavy) -> tuple[DataFrame, DataFrame]:
    """Rows of heavy keys, and all other rows.

    The heavy rows are checkpointed. So ``df`` is planned once, for the other
    rows, and a chain of operators grows by one branch each instead of doubling.
    """
    probe = F.broadcast(_prefixed(heavy.rows, heavy.keys))
    match = _same_keys(df, probe, heavy.keys)
    return cut_lineage(df.join(probe, match, "left_semi")), df.join(probe, match, "left_anti")


@dataclass(frozen=True)
class SplitFrame:
    """A table cut into the rows of heavy keys (``large``, or None) and all others, for a chain of group operators.

    Group operators take it in place of a table and keep the cut, so that the table is searched for heavy keys and
    split once for the chain: see :func:`split`. Its methods are those of a DataFrame that work row by row.
    """

    rest: DataFrame
    large: DataFrame | None
    keys: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return self.rest.columns

    @property
    def dtypes(self) -> list[tuple[str, str]]:
        return self.rest.dtypes

    def each(self, change: Callable[[DataFrame], DataFrame]) -> SplitFrame:
        """Both parts changed row by row; the keys must stay."""
        return SplitFrame(change(self.rest), None if self.large is None else change(self.large), self.keys)

    def select(self, *columns) -> SplitFrame:
        return self.each(lambda df: df.select(*columns))

    def filter(self, condition) -> SplitFrame:
        return self.each(lambda df: df.filter(condition))

    def withColumn(self, name: str, column: Column) -> SplitFrame:  # noqa: N802
        return self.each(lambda df: df.withColumn(name, column))

    def withColumns(self, columns: dict[str, Column]) -> SplitFrame:  # noqa: N802
        return self.each(lambda df: df.withColumns(columns))

    def drop(self, *columns: str) -> SplitFrame:
        return self.each(lambda df: df.drop(*columns))

    def merged(self) -> DataFrame:
        """All rows in one table again."""
        return self.rest if self.large is None else self.rest.unionByName(self.large)


Frame = TypeVar("Frame", DataFrame, SplitFrame)


def split(df: DataFrame, keys: str | Sequence[str], heavy: Heavy | None = None) -> SplitFrame:
    """Find the heavy keys of ``df`` and cut it for a chain of operators on ``keys``; end the chain with ``merged``."""
    heavy = heavy or find_heavy(df, keys)
    if heavy.rows is None:
        return SplitFrame(df, None, heavy.keys)
    large, rest = split_heavy(df, heavy)
    return SplitFrame(rest, large, heavy.keys)


def by_parts(
    df: Frame,
    keys: Sequence[str],
    heavy: Heavy | None,
    ordinary: Callable[[DataFrame], DataFrame],
    spread: Callable[[DataFrame], DataFrame],
) -> Frame:
    """Work on the rows of ordinary keys and on those of heavy keys in the way that suits each."""
    cut = df if isinstance(df, SplitFrame) else split(df, keys, heavy)
    if list(cut.keys) != list(keys):
        raise ValueError(f"split by {cut.keys}, not by {tuple(keys)}")
    made = SplitFrame(ordinary(cut.rest), None if cut.large is None else spread(cut.large), cut.keys)
    return made if isinstance(df, SplitFrame) else made.merged()


# ------------------------------------------------------------ group statistics


def with_stats(
    df: Frame,
    keys: str | Sequence[str],
    stats: dict[str, Column],
    heavy: Heavy | None = None,
) -> Frame:
    """Append aggregates of each row's group; rows with a NULL key get NULL.

    Ordinary groups share one Window, hence one shuffle for all statistics.
    Heavy groups are aggregated with map-side combine and joined back by
    broadcast, so their rows are never brought together.
    """
    keys = as_list(keys)
    if not stats:
        return df
    window = Window.partitionBy(*keys)
    present = all_present(keys)

    def windowed(part: DataFrame) -> DataFrame:
        values = [F.when(present, c.over(window)).alias(n) for n, c in stats.items()]
        return part.select("*", *values)

    def joined(large: DataFrame) -> DataFrame:
        table = large.filter(present).groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
        if isinstance(df, SplitFrame):  # at most maxHeavy rows; in a chain the plan must not double with each operator
            table = large.sparkSession.createDataFrame(table.toArrow(), table.schema)
        table = F.broadcast(_prefixed(table, keys))
        return large.join(table, _same_keys(large, table, keys), "left").select(large["*"], *stats)

    return by_parts(df, keys, heavy, windowed, joined)


# -------------------------------------------------------------- fitted tables


@dataclass(frozen=True)
class Fitted:
    """A per-key table computed once. ``small`` says its row count was checked."""

    rows: DataFrame
    small: bool


def freeze(table: DataFrame) -> Fitted:
    """Compute a per-key table once.

    Up to ``spark.groupstats.smallRows`` rows it becomes a local table that is
    safe to broadcast; larger ones stay in the shared folder.
    """
    spark = table.sparkSession
    rows = stored(table, "fitted")
    if rows.count() <= setting(spark, SMALL_ROWS):
        return Fitted(spark.createDataFrame(rows.toArrow(), schema=table.schema), True)
    return Fitted(rows, False)


def attach(
    df: DataFrame,
    fitted: Fitted,
    keys: str | Sequence[str],
    how: str = "inner",
    probe: DataFrame | None = None,
) -> DataFrame:
    """Equi-join rows to a fitted table with one row per key.

    A small table is broadcast. Against a large one, heavy keys are joined by
    broadcast of just their rows and the rest by shuffle. Heavy keys are looked
    for in ``probe``, a narrower frame with the same keys, if there is one.
    """
    keys = as_list(keys)
    if fitted.small:
        return df.join(F.broadcast(fitted.rows), keys, how)
    if df.isStreaming:  # a stream cannot be searched ahead, and a micro-batch is bounded by its trigger
        return df.join(fitted.rows, keys, how)
    heavy = find_heavy(df if probe is None else probe, keys)
    if heavy.rows is None:
        return df.join(fitted.rows, keys, how)
    large, rest = split_heavy(df, heavy)
    picked = fitted.rows.join(F.broadcast(heavy.rows), keys, "left_semi")
    return rest.join(fitted.rows, keys, how).unionByName(
        large.join(F.broadcast(picked), keys, how)
    )


def attach_many(
    df: DataFrame, fitted: Fitted, which: str, key: str, keys: dict[str, Column], how: str = "left"
) -> DataFrame:
    """Look up several keys of each row in one table that holds a table for each, named in its column ``which``.

    ``keys`` maps a table's name to the value to find in its column ``key``; the rest of the found row is appended as the
    struct ``_got_<name>``, NULL if there is none (``how="inner"`` drops rows that miss one).

    The smallest tables are broadcast, as many as fit ``spark.groupstats.smallRows`` together. All others take one
    shuffle, however many they are: the keys of a row become rows of (table, key), meet their table's rows, heavy keys by
    broadcast, and come back by row. They come first, while the rows are as narrow as they were given, and what is found by
    broadcast is added to the joined rows without a shuffle. Tables go by number there.
    """
    spark = df.sparkSession
    values = [c for c in fitted.rows.columns if c not in (which, key)]
    broadcast, spread = list(keys), []
    if not fitted.small:
        sizes = {r[which]: r["count"] for r in fitted.rows.groupBy(which).count().collect()}  # one row a table
        room, broadcast = setting(spark, SMALL_ROWS), []
        for name in sorted(keys, key=lambda n: (sizes.get(n, 0), n)):
            room -= sizes.get(name, 0)
            (broadcast if room >= 0 else spread).append(name)
    names = df.columns
    if spread:
        df = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        numbered = fitted.rows.filter(F.col(which).isin(spread)).withColumn(
            which, reduce(lambda c, i: c.when(F.col(which) == spread[i], i), range(1, len(spread)), F.when(F.col(which) == spread[0], 0))
        )
        asked = [F.struct(F.lit(i).alias(which), keys[name].cast(fitted.rows.schema[key].dataType).alias(key)) for i, name in enumerate(spread)]
        rows = df.select("_row", F.inline(F.array(*asked))).filter(F.col(key).isNotNull())
        met = attach(rows, Fitted(numbered, False), [which, key], "inner")
        got = met.groupBy("_row").agg(
            *[F.first(F.when(F.col(which) == i, F.struct(*values)), True).alias(f"_got_{name}") for i, name in enumerate(spread)]
        )
        df = df.join(got, "_row", "left").drop("_row")
    for name in broadcast:
        found = F.struct(*values).alias(f"_got_{name}")
        one = fitted.rows.filter(F.col(which) == name).select(F.col(key).alias("_looked_up"), found)
        df = df.withColumn("_looked_up", keys[name]).join(F.broadcast(one), "_looked_up", "left").drop("_looked_up")
    if how == "inner":
        df = df.filter(reduce(lambda a, b: a & b, [F.col(f"`_got_{name}`").isNotNull() for name in keys], F.lit(True)))
    return df.select(*names, *[f"`_got_{name}`" for name in keys])


# -------------------------------------------------------------------- ranking


def number_rows(
    df: Frame,
    keys: str | Sequence[str],
    order: Sequence[Column],
    name: str,
    heavy: Heavy | None = None,
) -> Frame:
    """Number the rows of each group 1..n by ``order``, which must be unique."""
    keys = as_list(keys)

    def numbered(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return part.select("*", F.row_number().over(window).cast("long").alias(name))

    return by_parts(df, keys, heavy, numbered, lambda large: number_sorted(large, keys, order, name))


def number_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """Number rows through a distributed sort whose layout a checkpoint fixes.

    ``monotonically_increasing_id`` holds the partition above bit 33 and the
    place inside it below. A group's part of a partition is contiguous, so a
    row's number is its place in that part plus the sizes of the earlier
    parts. There are at most (groups + partitions) parts to broadcast.
    """
    placed = cut_lineage(
        df.orderBy(*keys, *order).select("*", F.monotonically_increasing_id().alias("_place"))
    )
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    parts = (
        placed.groupBy(*keys, "_part")
        .agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_part").alias("_key__part"),
            "_first",
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    parts = F.broadcast(parts)
    joined = placed.join(parts, _same_keys(placed, parts, [*keys, "_part"]))
    number = F.col("_place") - F.col("_first") + F.col("_before") + 1
    return joined.select(*df.columns, number.cast("long").alias(name))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Append the sum of ``value`` over the rows of the same keys before this one in ``order``.

    As :func:`number_sorted`, by a distributed sort: a key of any size is summed in the parts that the sort makes of it.
    """
    placed = cut_lineage(df.orderBy(*keys, *order).select("*", F.spark_partition_id().alias("_part")))
    earlier = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    inside = earlier(Window.partitionBy(*keys, "_part").orderBy(*order))
    parts = placed.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum")).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_part").alias("_key__part"),
        F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*keys).orderBy("_part"))), F.lit(0)).alias("_before"),
    )
    summed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    parts = F.broadcast(parts)  # at most keys + partitions
    joined = summed.join(parts, _same_keys(summed, parts, [*keys, "_part"]))
    return joined.select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))


# ----------------------------------------------------------- exact hash order


def hash_of(columns: Sequence[str], seed: int) -> Column:
    """Repeatable shuffle order: hex digest of the seed and the id columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_cuts(
    ids: DataFrame,
    columns: Sequence[str],
    seed: int,
    ranks: Sequence[int] | Callable[[int], Sequence[int]],
) -> list[str]:
    """The digests at the given 1-based ranks of the hash order of ``ids``.

    Ranks may be a function of the number of ids. A rank below 1 gives a text
    before, one past the last id a text after every digest.

    Exact and without a global sort: count ids per hash range, find the range
    that holds each rank, and number only the ids of those ranges. What comes
    back to the driver is one count per range and one digest per rank. With a
    digest in hand, "the first n ids" is a comparison on each row.
    """
    hashed = ids.select(hash_of(columns, seed).alias("_hash"))
    prefix = F.substring("_hash", 1, HASH_PREFIX)
    sizes = hashed.groupBy(prefix.alias("_range")).agg(F.count(F.lit(1)).alias("_rows")).toArrow()
    counts = dict(zip(sizes["_range"].to_pylist(), sizes["_rows"].to_pylist()))
    if callable(ranks):
        ranks = ranks(sum(counts.values()))
    by_rank = sorted((rank, slot) for slot, rank in enumerate(ranks))
    wanted: dict[str, list[tuple[int, int]]] = {}
    before = done = 0
    for bucket in sorted(counts):
        end = before + counts[bucket]
        while done < len(by_rank) and by_rank[done][0] <= end:
            rank, slot = by_rank[done]
            if rank > 0:
                wanted.setdefault(bucket, []).append((slot, rank - before))
            done += 1
        before = end
    cuts = [PAST_LAST if rank > 0 else "" for rank in ranks]
    if not wanted:
        return cuts
    spark = ids.sparkSession
    ranges = spark.createDataFrame([(b,) for b in wanted], "_range string")
    places = sorted({(b, r) for b, slots in wanted.items() for _, r in slots})
    places = spark.createDataFrame(places, "_range string, _rank int")
    inside = (
        hashed.withColumn("_range", prefix)
        .join(F.broadcast(ranges), "_range", "left_semi")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy("_hash")))
    )
    hits = inside.join(F.broadcast(places), ["_range", "_rank"]).collect()
    found = {(r["_range"], r["_rank"]): r["_hash"] for r in hits}
    for bucket, slots in wanted.items():
        for slot, rank in slots:
            cuts[slot] = found[bucket, rank]
    return cuts
