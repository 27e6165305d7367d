"""Scaling by statistics of the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupstats.functions import columns as fc
from groupstats.functions import fixed

Moments = Mapping[str, tuple[float | None, float | None]]


def fit_moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Mean and sample deviation of each column, in one job."""
    if not columns:
        return {}
    stats = [F.struct(F.avg(c), F.stddev_samp(c)).alias(c) for c in columns]
    row = df.agg(*stats).first()
    return {c: (row[c][0], row[c][1]) for c in columns}


def _literal(value: float | None):
    return F.lit(value).cast("double")


def standardize(
    df: DataFrame,
    columns: Sequence[str],
    floor: float = fixed.STD_FLOOR,
    moments: Moments | None = None,
) -> DataFrame:
    """z-score over the table with a floor on the deviation."""
    moments = fit_moments(df, columns) if moments is None else moments
    return df.withColumns(
        {
            c: fc.standard_score(F.col(c), _literal(moments[c][0]), _literal(moments[c][1]), floor)
            for c in columns
        }
    ) if columns else df


def normalize(df: DataFrame, columns: Sequence[str], moments: Moments | None = None) -> DataFrame:
    """z-score over the table; a column without spread becomes 0."""
    moments = fit_moments(df, columns) if moments is None else moments
    scaled = {}
    for c in columns:
        mean, std = moments[c]
        scaled[c] = (F.col(c) - _literal(mean)) / _literal(std) if std else F.lit(0.0)
    return df.withColumns(scaled) if scaled else df
