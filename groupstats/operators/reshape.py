"""Groups as fixed-shape arrays.

Every row these operators build is bounded: padded groups by their width,
group rows by a chunk size. A group of any size is spread over many rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupstats.functions import fixed
from groupstats.session import SMALL_ROWS, cut_lineage, setting
from groupstats.skew import (
    HASH_PREFIX, Fitted, Heavy, as_list, attach, by_parts, hash_of, number_rows, number_sorted,
)

CHUNK_ROWS = 1024


def group_blocks(
    df: DataFrame,
    group: str,
    entry: str | Sequence[str],
    numbers: Sequence[str],
    codes: Sequence[str] = (),
    constants: Mapping[str, float] | None = None,
    width: int = fixed.GROUP_WIDTH,
    seed: int | None = None,
    mix: bool = True,
    heavy: Heavy | None = None,
) -> DataFrame:
    """All entries of each group in blocks of exactly ``width`` places.

    One row per ``block`` (from 0) of the group's ``blocks``; ``rows`` are the block's structs of ``pos`` (1..width), the
    columns and ``is_padded``. A group has as many blocks as its entries need. Places left over are padding: the mean
    of the whole group for numbers, 0 for codes, the given constants.

    Without a seed entries come in entry order and padding last. With one they come in hash order of the entry, and padding has
    hashes of its own among them, so that no place tells padding from entries; ``mix=False`` leaves padding last.
    Rows without a group are left out.

    Numbers and means come from one window, hence one shuffle, which the grouping into blocks finds in place. A heavy
    group is numbered by a distributed sort and its blocks are spread over the tasks.
    """
    constants = dict(constants or {})
    columns = [*numbers, *codes, *constants]
    known = df.filter(F.col(group).isNotNull()).select(group, *dict.fromkeys([*as_list(entry), *columns]))
    mixed = mix and seed is not None
    order = [F.col(e).asc() for e in as_list(entry)]
    if seed is not None:
        known = known.withColumn("_digest", hash_of(as_list(entry), seed))
        order = [F.col("_digest").asc(), *order]
    stats = {"_entries": F.count(F.lit(1)), **{f"_mean_{k}": F.avg(c) for k, c in enumerate(numbers)}}
    spare = F.pmod(-F.col("_entries"), F.lit(width))
    digests = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(width)), lambda j: j <= spare),
        lambda j: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.lit("pad"), j.cast("string"))),
    )

    def windowed(part: DataFrame) -> DataFrame:
        ordered = Window.partitionBy(group).orderBy(*order)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        part = part.select(
            "*", F.row_number().over(ordered).cast("long").alias("_number"), *[c.over(whole).alias(n) for n, c in stats.items()]
        )
        if not mixed:
            return part
        first = F.when(F.col("_number") == 1, digests)  # worked out once a group
        return part.select("*", first.alias("_first")).select("*", F.max("_first").over(Window.partitionBy(group)).alias("_pads")).drop("_first")

    def spread(large: DataFrame) -> DataFrame:
        table = large.groupBy(group).agg(*[c.alias(n) for n, c in stats.items()])
        table = table.withColumn("_pads", digests) if mixed else table
        return number_sorted(large, [group], order, "_number").join(F.broadcast(table), group)

    placed = by_parts(known, [group], heavy, windowed, spread)
    number = F.col("_number") - 1
    if mixed:  # padding before the entry
        number = number + F.size(F.filter("_pads", lambda d: d < F.col("_digest")))
    placed = placed.withColumn("_place", number).withColumns(
        {"block": F.floor(F.col("_place") / width).cast("int"), "pos": (F.col("_place") % width + 1).cast("int")}
    )
    held = F.struct("pos", *columns, F.lit(0).alias("is_padded"))
    blocks = placed.groupBy(group, "block").agg(
        F.collect_list(held).alias("_held"), *[F.first(n).alias(n) for n in stats]
    )
    types = dict(df.dtypes)
    means = {c: F.col(f"_mean_{k}") for k, c in enumerate(numbers)}

    def padding(c: str) -> Column:
        value = F.lit(constants[c]) if c in constants else F.lit(0) if c in set(codes) else means[c]
        return value.cast(types[c]).alias(c)

    free = F.array_except(F.sequence(F.lit(1), F.lit(width)), F.col("_held.pos"))
    blank = F.transform(free, lambda i: F.struct(i.alias("pos"), *map(padding, columns), F.lit(1).alias("is_padded")))
    return blocks.select(
        group, "block", F.ceil(F.col("_entries") / width).cast("int").alias("blocks"),
        F.sort_array(F.concat("_held", blank)).alias("rows"),
    )


def pad_groups(
    df: DataFrame,
    group: str,
    entry: str | Sequence[str],
    numbers: Sequence[str],
    codes: Sequence[str] = (),
    constants: Mapping[str, float] | None = None,
    width: int = fixed.GROUP_WIDTH,
    seed: int | None = None,
    mix: bool = True,
    heavy: Heavy | None = None,
) -> DataFrame:
    """The blocks of :func:`group_blocks` as rows: ``width`` for every block, none of a group's entries left out."""
    blocks = group_blocks(df, group, entry, numbers, codes, constants, width, seed, mix, heavy)
    return blocks.select(group, "block", F.inline("rows"))


def pad_wide_groups(
    df: DataFrame,
    group: str,
    entry: str | Sequence[str],
    numbers: Sequence[str],
    codes: Sequence[str] = (),
    constants: Mapping[str, float] | None = None,
    width: int = fixed.GROUP_WIDTH,
    seed: int | None = None,
    heavy: Heavy | None = None,
) -> DataFrame:
    """As :func:`pad_groups`, with padding always last."""
    return pad_groups(df, group, entry, numbers, codes, constants, width, seed, False, heavy)


def block_tensors(
    blocks: DataFrame, group: str, numbers: Sequence[str], codes: Sequence[str] = (), labels: Sequence[str] = ()
) -> DataFrame:
    """One row per block of :func:`group_blocks`: ``main`` is [width][number], each code and label is [width].

    ``blocks`` stays, so that losses know the size of the whole group.
    """
    main = F.transform("rows", lambda r: F.array(*[r[c].cast("double") for c in numbers])).alias("main")
    return blocks.select(group, "block", "blocks", main, *[F.col(f"rows.{c}").alias(c) for c in [*codes, *labels]])


def to_tensors(
    padded: DataFrame, group: str, numbers: Sequence[str], codes: Sequence[str] = (), labels: Sequence[str] = ()
) -> DataFrame:
    """The arrays of :func:`block_tensors` from padded rows, collected again; for rows that were changed in between."""
    keys = [group, "block"] if "block" in padded.columns else [group]
    main = F.array(*[F.col(c).cast("double") for c in numbers]).alias("main")
    fields = [F.col("pos"), main, *[F.col(c) for c in [*codes, *labels]]]
    rows = padded.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows"))
    return rows.select(*keys, *[F.col(f"_rows.{c}").alias(c) for c in ["main", *codes, *labels]])


def group_rows(
    df: DataFrame,
    group: str,
    entry: str | Sequence[str],
    numbers: Sequence[str],
    target: str,
    chunk_rows: int = CHUNK_ROWS,
    heavy: Heavy | None = None,
) -> DataFrame:
    """One row per group with its matrix ``x`` and target vector ``y``.

    Groups above ``chunk_rows`` entries continue in further rows numbered
    ``chunk``; together the chunks hold every entry in entry order.
    """
    order = [F.col(e).asc() for e in as_list(entry)]
    placed = number_rows(df.filter(F.col(group).isNotNull()), group, order, "_pos", heavy)
    x = F.array(*[F.col(c).cast("double") for c in numbers]).alias("x")
    fields = F.struct(F.col("_pos"), x, F.col(target).alias("y"))
    chunk = F.floor((F.col("_pos") - 1) / chunk_rows).cast("int")
    rows = placed.groupBy(group, chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(fields)).alias("_rows")
    )
    return rows.select(group, "chunk", F.col("_rows.x").alias("x"), F.col("_rows.y").alias("y"))


def drawn_groups(df: DataFrame, group: str, draws: int, per_draw: int = 1, seed: int = 0) -> DataFrame:
    """Groups drawn with replacement, as (draw, part, digest of the group).

    Draw ``d``, part ``j`` takes the group at a pseudo-random rank of the hash
    order. The table has ``draws * per_draw`` rows.

    A directory of hash ranges holds how many groups lie before and in each (65,536 rows at most). Every rank finds its range in
    it, and its group by number inside the range; only the number of groups comes to the driver.
    """
    spark = df.sparkSession
    hashed = df.select(group).filter(F.col(group).isNotNull()).distinct().select(hash_of([group], seed).alias("_digest"))
    hashed = cut_lineage(hashed.withColumn("_range", F.substring("_digest", 1, HASH_PREFIX)))
    sizes = hashed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    directory = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    groups = hashed.count()
    lots = spark.range(draws * per_draw).select(
        F.floor(F.col("id") / per_draw).cast("int").alias("draw"),
        (F.col("id") % per_draw).cast("int").alias("part"),
    )
    number = F.conv(F.substring(hash_of(["draw", "part"], seed), 1, 12), 16, 10).cast("long")
    lots = lots.withColumn("_rank", F.try_mod(number, F.lit(groups)))  # from 0
    # ranks meet ranges by slots of equal width: a range lies in those it touches, at most two rows a range in all
    width = max(1, -(-groups >> 4 * HASH_PREFIX))
    slots = F.sequence(F.floor(F.col("_before") / width), F.floor((F.col("_before") + F.col("_size") - 1) / width))
    directory = directory.withColumn("_slot", F.explode(slots))
    placed = lots.withColumn("_slot", F.floor(F.col("_rank") / width)).join(F.broadcast(directory), "_slot").filter(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size"))
    )
    placed = placed.select("draw", "part", "_range", (F.col("_rank") - F.col("_before") + 1).alias("_number"))
    inside = Window.partitionBy("_range").orderBy("_digest")
    numbered = hashed.withColumn("_number", F.row_number().over(inside).cast("long"))
    return placed.join(numbered, ["_range", "_number"]).select("draw", "part", "_digest")


def draw_groups(df: DataFrame, group: str, draws: int, per_draw: int = 1, seed: int = 0) -> DataFrame:
    """Entries of groups drawn with replacement.

    Entries of all parts of a draw form one merged group named by ``draw``,
    ready for :func:`group_rows` with ``draw`` as the group.
    """
    lots = cut_lineage(drawn_groups(df, group, draws, per_draw, seed))
    hashed = df.withColumn("_digest", hash_of([group], seed))
    small = draws * per_draw <= setting(df.sparkSession, SMALL_ROWS)
    return attach(hashed, Fitted(lots, small), "_digest").drop("_digest")
