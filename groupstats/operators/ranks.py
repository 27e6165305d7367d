"""Order inside a group: popularity, predicted rank, picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupstats.functions import columns as fc
from groupstats.skew import (
    Frame, Heavy, as_list, attach, by_parts, freeze, hash_of, number_rows, running_total, with_stats,
)


def append_popularity(
    df: DataFrame,
    group: str,
    odds: str = "li_WinOdds",
    entry: str | Sequence[str] = "entry_id",
    name: str = "pops_order",
    heavy: Heavy | None = None,
) -> DataFrame:
    """Number the entries of a group from the lowest odds up; ties by entry id.

    Odds below 1 or missing count, and are stored, as the default.
    """
    if odds not in df.columns:
        return df
    df = df.withColumn(odds, fc.usable_odds(F.col(odds)))
    order = [F.col(odds).asc(), *[F.col(e).asc() for e in as_list(entry)]]
    return number_rows(df, group, order, name, heavy)


def append_pred_order(
    df: Frame,
    group: str,
    pred: str = "pred",
    name: str = "pred_order",
    heavy: Heavy | None = None,
) -> Frame:
    """Ascending rank of the prediction in its group, ties share the lowest rank.

    A missing prediction has no rank.

    Heavy groups are ranked by value: the entries of each (group, prediction) are counted, the counts of lower
    predictions are summed along a distributed sort of the values, and the ranks are joined back. So neither a group nor a
    prediction that many of its entries share lies in one task.
    """
    has_rank = F.col(pred).isNotNull() & F.col(group).isNotNull()

    def ranked(part: DataFrame) -> DataFrame:
        window = Window.partitionBy(group).orderBy(F.col(pred).asc_nulls_last())
        return part.select(
            "*", F.when(has_rank, F.rank().over(window).cast("long")).alias(name)
        )

    def by_value(large: DataFrame) -> DataFrame:
        values = large.filter(has_rank).groupBy(group, pred).agg(F.count(F.lit(1)).alias("_count"))
        lower = running_total(values, [group], [F.col(pred).asc()], "_count", "_lower")
        ranks = lower.select(group, pred, (F.col("_lower") + 1).cast("long").alias(name))
        columns = large.columns
        return attach(large, freeze(ranks), [group, pred], "left").select(*columns, name)

    return by_parts(df, [group], heavy, ranked, by_value)


def append_value_flag(
    df: DataFrame, pred_order: str = "pred_order", popularity: str = "pops_order", name: str = "kaime"
) -> DataFrame:
    """1 where the model ranks the entry ahead of the crowd."""
    return df.withColumn(name, fc.less_flag(F.col(pred_order), F.col(popularity), "tinyint"))


def pick_order(pred: str, entry: str | Sequence[str], mode: str = "argmax") -> Column:
    """Sort key whose minimum is the pick; NULL for rows that cannot be picked."""
    if mode not in ("argmax", "argmin"):
        raise ValueError("mode is argmax or argmin")
    score = -F.col(pred) if mode == "argmax" else F.col(pred)
    return F.when(
        F.col(pred).isNotNull(),
        F.struct(score.alias("score"), *[F.col(e).alias(f"tie_{e}") for e in as_list(entry)]),
    )


def best_of_group(
    df: DataFrame,
    group: str,
    pred: str,
    entry: str | Sequence[str],
    mode: str = "argmax",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per group: its picked entry and the carried columns.

    The pick is an aggregate, so each task sends one candidate per group.
    """
    best = F.min_by(
        F.struct(*[F.col(c) for c in dict.fromkeys([*as_list(entry), *carry])]),
        pick_order(pred, entry, mode),
    )
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(best.alias("_best")).select(group, "_best.*")


def append_pick(
    df: DataFrame,
    group: str,
    pred: str,
    entry: str | Sequence[str],
    mode: str = "argmax",
    name: str = "pred_bin",
    heavy: Heavy | None = None,
) -> DataFrame:
    """1 for the one picked entry of each group, ties by entry id."""
    order = pick_order(pred, entry, mode)
    best = with_stats(df, group, {"_best": F.min(order)}, heavy)
    return best.withColumn(name, F.coalesce(order == F.col("_best"), F.lit(False)).cast("int")).drop("_best")


def append_first_of_group(
    df: DataFrame, group: str, entry: str | Sequence[str], width: int, name: str, seed: int | None = None
) -> DataFrame:
    """Number entries by id (or by hash of it) and keep the first ``width`` of each group.

    Spark keeps at most ``width`` rows per group on the map side, so a group
    of any size stays small in the shuffle.
    """
    ids = as_list(entry)
    order = [F.col(e).asc() for e in ids] if seed is None else [hash_of(ids, seed)]
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= width)


def shuffled(df: DataFrame, entry: str | Sequence[str], seed: int) -> DataFrame:
    """All rows in a repeatable random order, by distributed sort."""
    return df.orderBy(hash_of(as_list(entry), seed))


def by_importance(table: DataFrame, column: str = "importance") -> DataFrame:
    """Feature importances from small to large."""
    return table.orderBy(F.col(column).asc(), "feature")
