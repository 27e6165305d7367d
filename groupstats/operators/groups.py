"""Statistics of an entry relative to its group, and group-level filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupstats.functions import columns as fc
from groupstats.functions import fixed
from groupstats.operators.scaling import standardize
from groupstats.skew import Fitted, Heavy, as_list, attach, freeze, with_stats


def _with_moments(df: DataFrame, group: str, columns: Sequence[str], heavy: Heavy | None) -> DataFrame:
    stats: dict[str, Column] = {}
    for c in columns:
        stats[f"_mean_{c}"] = F.avg(c)
        stats[f"_std_{c}"] = F.stddev_samp(c)
    return with_stats(df, group, stats, heavy)


def group_zscore(
    df: DataFrame,
    group: str,
    columns: Sequence[str],
    floor: float = fixed.STD_FLOOR,
    heavy: Heavy | None = None,
) -> DataFrame:
    """Replace columns by their z-score in the group; a lone entry gets NULL."""
    wanted = [c for c in df.columns if c in set(columns) and c != group]
    scored = _with_moments(df, group, wanted, heavy)
    z = {
        c: fc.standard_score(F.col(c), F.col(f"_mean_{c}"), F.col(f"_std_{c}"), floor) for c in wanted
    }
    return scored.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])


def append_group_zscore(
    df: DataFrame,
    group: str,
    columns: Sequence[str],
    floor: float = fixed.STD_FLOOR,
    suffix: str = "_norm",
    heavy: Heavy | None = None,
) -> DataFrame:
    """Append ``<c>_norm``, the z-score in the group, for all but the label columns."""
    wanted = [c for c in columns if c != group and c not in fixed.NOT_NORMALISED]
    scored = _with_moments(df, group, wanted, heavy)
    z = [
        fc.standard_score(F.col(c), F.col(f"_mean_{c}"), F.col(f"_std_{c}"), floor).alias(c + suffix)
        for c in wanted
    ]
    return scored.select(*df.columns, *z)


def mixed_normalize(
    df: DataFrame,
    group: str,
    codes: Sequence[str],
    group_level: Sequence[str] = tuple(fixed.GROUP_LEVEL_FEATURES),
    untouched: Sequence[str] = (*fixed.BINARY_FEATURES, *fixed.UNSCALED_LABELS),
    heavy: Heavy | None = None,
) -> DataFrame:
    """Scale group-level columns over the table and all other numbers within the group."""
    level = [c for c in df.columns if c in set(group_level)]
    skip = {*codes, *level, *untouched, group}
    numbers = [c for c in df.columns if c not in skip]
    return standardize(group_zscore(df, group, numbers, heavy=heavy), level)


def append_group_means(
    df: DataFrame, group: str, columns: Sequence[str], heavy: Heavy | None = None
) -> DataFrame:
    """Append ``<c>_mean``, the mean of the group."""
    wanted = [c for c in df.columns if c in set(columns) and c != group]
    return with_stats(df, group, {f"{c}_mean": F.avg(c) for c in wanted}, heavy)


def append_margin(
    df: DataFrame,
    group: str,
    time: str = "hr_FinishingTime",
    name: str = "margin",
    heavy: Heavy | None = None,
) -> DataFrame:
    """Gap to the fastest entry of the group; a zero time counts as missing.

    Rows without a group drop out.
    """
    if "_fastest" in df.columns:
        raise ValueError("column _fastest is taken")
    df = df.filter(F.col(group).isNotNull()).withColumn(time, fc.zero_to_null(F.col(time)))
    df = with_stats(df, group, {"_fastest": F.min(time)}, heavy)
    return df.withColumn(name, F.col(time) - F.col("_fastest")).drop("_fastest")


def append_code_shares(
    df: DataFrame,
    group: str,
    code: str = "hi_RunningStyle",
    shares: Mapping[str, str] = fixed.STYLE_SHARES,
    heavy: Heavy | None = None,
) -> DataFrame:
    """Append the share of each listed code among the entries of the group.

    Rows without a group drop out, as in an inner join to the group table.
    """
    counts = {f"_n_{n}": F.count(F.when(F.col(code) == v, 1)) for v, n in shares.items()}
    kept = df.filter(F.col(group).isNotNull())
    counted = with_stats(kept, group, {**counts, "_size": F.count(F.lit(1))}, heavy)
    ratios = [(F.col(f"_n_{n}") / F.col("_size")).alias(n) for n in shares.values()]
    return counted.select(*df.columns, *ratios)


def leave_one_out(
    df: DataFrame,
    group: str,
    values: Mapping[str, str],
    count: str = "others",
    heavy: Heavy | None = None,
) -> DataFrame:
    """Append, per entry, sums over the *other* entries of its group and their number.

    ``values`` maps each result name to the column it sums; NULL adds 0.
    """
    stats = {f"_sum_{n}": F.sum(F.coalesce(F.col(c), F.lit(0))) for n, c in values.items()}
    summed = with_stats(df, group, {**stats, "_size": F.count(F.lit(1))}, heavy)
    rest = [
        (F.col(f"_sum_{n}") - F.coalesce(F.col(c), F.lit(0))).alias(n) for n, c in values.items()
    ]
    return summed.select(*df.columns, *rest, (F.col("_size") - 1).alias(count))


# ------------------------------------------------------------- group filters


def drop_groups_without(
    df: DataFrame, group: str, flag: str = "is_win", heavy: Heavy | None = None
) -> DataFrame:
    """Drop groups whose largest flag is not 1, also those without any value.

    Rows without a group stay: no group was found wanting for them.
    """
    best = with_stats(df, group, {"_best": F.max(flag)}, heavy)
    keep = F.col(group).isNull() | F.coalesce(F.col("_best") == 1, F.lit(False))
    return best.filter(keep).drop("_best")


def drop_groups_zero_sum(
    df: DataFrame, group: str, target: str = "hr_PaybackWin", heavy: Heavy | None = None
) -> DataFrame:
    """Drop groups whose target sums to 0; missing values add 0."""
    total = with_stats(df, group, {"_total": F.sum(target)}, heavy)
    keep = F.col(group).isNull() | (F.coalesce(F.col("_total"), F.lit(0)) != 0)
    return total.filter(keep).drop("_total")


def keep_groups(df: DataFrame, groups: DataFrame | Fitted, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose group is listed."""
    keys = as_list(keys)
    if isinstance(groups, DataFrame):
        groups = freeze(groups.select(*keys).distinct())
    return attach(df, groups, keys).select(*df.columns)


def drop_listed_groups(df: DataFrame, groups: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose group is not listed."""
    keys = as_list(keys)
    listed = freeze(groups.select(*keys).distinct().withColumn("_listed", F.lit(True)))
    marked = attach(df, listed, keys, "left")
    return marked.filter(F.col("_listed").isNull()).select(*df.columns)
