"""Missing values: counting, filling, profiling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupstats.functions import columns as fc
from groupstats.skew import Heavy, with_stats


def null_count(df: DataFrame, name: str = "null_count", columns: Sequence[str] | None = None) -> DataFrame:
    """Append the number of NULL cells of each row."""
    cells = [F.col(c).isNull().cast("int") for c in (columns or df.columns)]
    return df.withColumn(name, sum(cells, F.lit(0)))


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: share of cells that are not NULL."""
    columns = list(columns or df.columns)
    filled = sum((F.count(c) for c in columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(columns)
    return df.agg(F.try_divide(filled, cells).alias("completeness"))


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean of each column in one job; a column without values has mean 0."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def fill_global(
    df: DataFrame,
    numbers: Sequence[str],
    codes: Sequence[str] = (),
    code_fill: str = "nan",
    means: Mapping[str, float] | None = None,
) -> DataFrame:
    """Fill numbers with the column mean (fitted here unless given) and codes with a marker."""
    means = column_means(df, numbers) if means is None else means
    filled = {c: F.coalesce(F.col(c), F.lit(float(means[c]))) for c in numbers}
    filled |= {c: F.coalesce(F.col(c), F.lit(code_fill)) for c in codes}
    return df.withColumns(filled)


def fill_group(
    df: DataFrame,
    group: str,
    numbers: Sequence[str],
    codes: Sequence[str] = (),
    code_fill: str = "nan",
    then_zero: bool = True,
    heavy: Heavy | None = None,
) -> DataFrame:
    """Fill numbers with the mean of their group, then 0, and codes with a marker."""
    columns = df.columns
    df = with_stats(df, group, {f"_mean_{c}": F.avg(c) for c in numbers}, heavy)
    filled = {}
    for c in numbers:
        parts = [F.col(c), F.col(f"_mean_{c}")]
        filled[c] = F.coalesce(*parts, F.lit(0.0)) if then_zero else F.coalesce(*parts)
    filled |= {c: F.coalesce(F.col(c), F.lit(code_fill)) for c in codes}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in columns])


def fill_zero(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(numbers))


def scale_paybacks(df: DataFrame, columns: Sequence[str] = ("hr_PaybackWin", "hr_PaybackPlace")) -> DataFrame:
    """Paybacks per unit: uncapped as ``<c>_eval``, capped at 100 in place."""
    scaled = {f"{c}_eval": fc.payback_ratio(F.col(c)) for c in columns}
    scaled |= {c: fc.payback_capped(F.col(c)) for c in columns}
    return df.withColumns(scaled)


def column_profile(df: DataFrame, numbers: Sequence[str], codes: Sequence[str] = ()) -> DataFrame:
    """One row per column: kind, mean and sample deviation (NULL for codes)."""
    stats = df.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in numbers]
    )
    nothing = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit("numerical").alias("kind"),
            F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std"),
        )
        for c in numbers
    ] + [
        F.struct(
            F.lit(c).alias("column"), F.lit("categorical").alias("kind"),
            nothing.alias("mean"), nothing.alias("std"),
        )
        for c in codes
    ]
    return stats.select(F.inline(F.array(*rows)))
