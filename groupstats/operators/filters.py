"""Row filters. Each is a plain predicate, so Catalyst pushes it to the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_label(df: DataFrame, labels: Sequence[str], nonzero: Sequence[str] = ()) -> DataFrame:
    """Rows whose labels are present and, where asked, not zero."""
    df = df.dropna(subset=list(labels))
    for name in nonzero:
        df = df.filter(F.col(name) != 0)
    return df


def without_codes(df: DataFrame, column: str, codes: Iterable[str] = ("0s", "s")) -> DataFrame:
    """Rows whose code is not listed; a missing code stays."""
    return df.filter(F.coalesce(~F.col(column).isin(list(codes)), F.lit(True)))


def only_code(df: DataFrame, column: str, code: str = "sprint") -> DataFrame:
    return df.filter(F.col(column) == code)


def from_year(df: DataFrame, year: int, column: str = "ri_Year") -> DataFrame:
    return df.filter(F.col(column) >= year)


def only_years(
    df: DataFrame, years: Iterable[int] | None = None, column: str = "ri_Year"
) -> DataFrame:
    """Rows of the listed years; everything if there is no list or no year column."""
    if years is None or column not in df.columns:
        return df
    return df.filter(F.col(column).isin([int(y) for y in years]))
