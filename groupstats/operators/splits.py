"""Splits and balanced samples. Group and row splits are exact and repeatable.

They follow the hash order of ids instead of a seeded shuffle, so a split is a
comparison of each row's digest with a few cut points: no sort of the table,
no join, the same result on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupstats.functions import fixed
from groupstats.skew import as_list, hash_cuts, hash_of


def split_by_year(
    df: DataFrame, year: int, column: str = "ri_Year", drop: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows before ``year`` and rows from it on."""
    parts = df.filter(F.col(column) < year), df.filter(F.col(column) >= year)
    return tuple(p.drop(column) for p in parts) if drop else parts


def _cuts_passed(digest: Column, cuts: Sequence[str]) -> Column:
    """Number of cut points strictly below the digest."""
    return sum(((digest > cut).cast("int") for cut in cuts), F.lit(0))


def append_group_fold(
    df: DataFrame, group: str, folds: int, seed: int = fixed.FOLD_SEED, name: str = "fold"
) -> DataFrame:
    """Fold number of each group: equal chunks of the shuffled groups, rest to the last fold."""
    ids = df.select(group).filter(F.col(group).isNotNull()).distinct()
    cuts = hash_cuts(ids, [group], seed, lambda n: [n // folds * i for i in range(1, folds)])
    fold = _cuts_passed(hash_of([group], seed), cuts)
    return df.withColumn(name, F.when(F.col(group).isNotNull(), fold))


def append_row_fold(
    df: DataFrame, entry: str | Sequence[str], folds: int = 3, seed: int = fixed.HOLDOUT_SEED, name: str = "fold"
) -> DataFrame:
    """Fold number of each row: chunks of the shuffled rows whose sizes differ by at most one."""
    ids = as_list(entry)

    def ends(rows: int) -> list[int]:
        size, more = divmod(rows, folds)
        return [size * i + min(i, more) for i in range(1, folds)]

    cuts = hash_cuts(df, ids, seed, ends)
    return df.withColumn(name, _cuts_passed(hash_of(ids, seed), cuts))


def fold_frames(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training rows and test rows of one fold."""
    test = F.col(column) == fold
    return df.filter(~F.coalesce(test, F.lit(False))), df.filter(test)


def hold_out_groups(
    df: DataFrame,
    group: str,
    groups: int = fixed.HOLDOUT_GROUPS,
    seed: int = fixed.HOLDOUT_SEED,
    name: str = "is_test",
) -> DataFrame:
    """Mark the rows of the first ``groups`` groups in hash order."""
    ids = df.select(group).filter(F.col(group).isNotNull()).distinct()
    (cut,) = hash_cuts(ids, [group], seed, [groups])
    return df.withColumn(name, hash_of([group], seed) <= cut)


def random_split(
    df: DataFrame, entry: str | Sequence[str], test: float = 0.1, seed: int = fixed.HOLDOUT_SEED
) -> list[DataFrame]:
    """Training and test rows, each row by the digest of its id: the same under any layout, and after a retry.

    Rows with the same id fall on the same side.
    """
    is_test = uniform(entry, seed) < test
    return [df.filter(~is_test), df.filter(is_test)]


def uniform(entry: str | Sequence[str], seed: int) -> Column:
    """A repeatable number from 0 up to 1: the first 12 hex digits of the id's digest."""
    digits = F.substring(hash_of(as_list(entry), seed), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def _class_sizes(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return row[0], row[1]


def downsample(
    df: DataFrame, label: str, entry: str | Sequence[str], seed: int = fixed.HOLDOUT_SEED
) -> DataFrame:
    """All rows of class 1 and equally many of class 0, drawn in hash order.

    With fewer negatives than positives all negatives stay.
    """
    ids = as_list(entry)
    _, positives = _class_sizes(df, label)
    kept = F.col(label) == 1
    if positives:
        negatives = df.filter(F.col(label) == 0)
        (cut,) = hash_cuts(negatives, ids, seed, [positives])
        kept = kept | ((F.col(label) == 0) & (hash_of(ids, seed) <= cut))
    return df.filter(kept)


def upsample(
    df: DataFrame, label: str, entry: str | Sequence[str], seed: int = fixed.HOLDOUT_SEED, copy: str = "copy"
) -> DataFrame:
    """All rows of class 0 and class 1 repeated to the same number.

    Positives are cycled: each appears ``n0 div n1`` times, the first
    ``n0 mod n1`` of them in hash order once more. ``copy`` numbers the
    repeats. The repeats are made where the row lies, without a shuffle.
    """
    ids = as_list(entry)
    negatives, positives = _class_sizes(df, label)
    zeros = df.filter(F.col(label) == 0).withColumn(copy, F.lit(0))
    if not positives:
        return zeros
    times, more = divmod(negatives, positives)
    ones = df.filter(F.col(label) == 1)
    repeats = F.lit(times)
    if more:
        (cut,) = hash_cuts(ones, ids, seed, [more])
        repeats = repeats + (hash_of(ids, seed) <= cut).cast("int")
    ones = ones.withColumn("_times", repeats).filter(F.col("_times") > 0)
    ones = ones.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_times")
    return zeros.unionByName(ones)


def flip_action(
    action: Column, entry: str | Sequence[str], epsilon: float = 0.05, seed: int = fixed.HOLDOUT_SEED
) -> Column:
    """A 0/1 action flipped with probability ``epsilon``, drawn by the row's id."""
    return F.when(uniform(entry, seed) < epsilon, 1 - action).otherwise(action)


def draw_action(p_skip: Column, entry: str | Sequence[str], seed: int = fixed.HOLDOUT_SEED) -> Column:
    """Action 1 with probability ``1 - p_skip``, drawn by the row's id."""
    return (uniform(entry, seed) > p_skip).cast("int")
