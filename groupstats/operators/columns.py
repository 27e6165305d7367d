"""Column management: which columns are codes, features, labels, and in what order."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupstats.functions import columns as fc
from groupstats.functions import fixed


def codes_and_numbers(df: DataFrame, more_codes: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Names of code columns (strings and ``more_codes``) and numeric columns, sorted."""
    more = set(more_codes)
    codes = [f.name for f in df.schema if f.name in more or isinstance(f.dataType, T.StringType)]
    numbers = [
        f.name for f in df.schema if f.name not in more and isinstance(f.dataType, T.NumericType)
    ]
    return sorted(codes), sorted(numbers)


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def present_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The listed columns the frame has, in frame order."""
    wanted = set(columns)
    return [c for c in df.columns if c in wanted]


def drop_listed(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def drop_or_keep(
    df: DataFrame,
    remove: Sequence[str] | None = None,
    keep: Sequence[str] | None = None,
    always_drop: Sequence[str] = tuple(fixed.ALWAYS_DROPPED),
) -> DataFrame:
    """Drop ``remove``, or keep exactly ``keep``; the presence flags always go when dropping."""
    if remove is not None and keep is not None:
        raise ValueError("give either columns to remove or columns to keep, not both")
    if keep is not None:
        return df.select(*keep)
    if remove is not None:
        return df.drop(*remove, *always_drop)
    return df


def choose_columns(
    df: DataFrame,
    remove: Sequence[str] | None = None,
    keep: Sequence[str] | None = None,
    process_features: Sequence[str] = (),
) -> DataFrame:
    """Drop ``remove`` and sort the rest, or keep ``keep`` plus the process features."""
    if remove is not None and keep is not None:
        raise ValueError("give either columns to remove or columns to keep, not both")
    if remove is not None:
        return sort_columns(df.drop(*remove))
    if keep is not None:
        return df.select(*present_columns(df, [*keep, *process_features]))
    return df


def feature_names(df: DataFrame, guards: Sequence[str] = tuple(fixed.PROCESS_FEATURES)) -> list[str]:
    """Columns that do not start with any guarded name, sorted."""
    return sorted(c for c in df.columns if not c.startswith(tuple(guards)))


def features_and_label(
    df: DataFrame, label: str, guards: Sequence[str] = tuple(fixed.PROCESS_FEATURES)
) -> DataFrame:
    """Unguarded features plus the label as ``label``."""
    return df.select(*feature_names(df, guards), F.col(label).alias("label"))


def drop_process_features(
    df: DataFrame, names: Sequence[str] = tuple(fixed.PROCESS_FEATURES)
) -> DataFrame:
    return df.drop(*names)


def policy_process_features() -> list[str]:
    """Process features of the buy/skip run, which may look at the odds."""
    names = dict.fromkeys([*fixed.POLICY_EXTRA_PROCESS_FEATURES, *fixed.PROCESS_FEATURES])
    return [n for n in names if n not in fixed.POLICY_ALLOWED_FEATURES]


def numbers_codes_others(
    df: DataFrame, codes: Sequence[str], numbers: Sequence[str]
) -> DataFrame:
    """Reorder columns: numbers, codes, then all others."""
    listed = [*numbers, *codes]
    return df.select(*listed, *[c for c in df.columns if c not in set(listed)])


def cast_columns(df: DataFrame, columns: Iterable[str], kind: str) -> DataFrame:
    wanted = set(columns)
    return df.select(*[F.col(c).cast(kind).alias(c) if c in wanted else F.col(c) for c in df.columns])


def to_float(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return cast_columns(df, columns, "float")


def shrink_codes(df: DataFrame, codes: Iterable[str]) -> DataFrame:
    """Label codes as 32-bit integers."""
    return cast_columns(df, codes, "int")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing marker: NaN in any floating column becomes NULL."""
    floating = (T.FloatType, T.DoubleType)
    return df.select(
        *[
            fc.nan_to_null(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def slot_prefix(name: str) -> str:
    """Text before the first underscore."""
    return name.split("_", 1)[0]


def without_prefix(name: str) -> str:
    """Text after the first underscore."""
    return name.partition("_")[2]


def encoded_name(name: str, prefixes: Sequence[str] = tuple(fixed.ENCODED_PREFIXES)) -> str:
    """Lower-case name, without its family prefix if that is a known one."""
    return (without_prefix(name) if slot_prefix(name) in prefixes else name).lower()
