"""Column expressions. All are built-in functions, so they stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from groupstats.functions import fixed

# ---------------------------------------------------------------- numbers


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` limited to a range; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def floored(std: Column, floor: float | None) -> Column:
    """A deviation not below ``floor``; an undefined deviation stays NULL."""
    if floor is None:
        return std
    return F.when(std.isNotNull(), F.greatest(std, F.lit(floor)))


def standard_score(value: Column, mean: Column, std: Column, floor: float | None = None) -> Column:
    """``(value - mean) / std``, NULL where the deviation is zero or undefined."""
    return F.try_divide(value - mean, floored(std, floor))


def log_shifted(value: Column) -> Column:
    """``log(1 + value)``, NULL at or below -1."""
    return F.log1p(value)


def logistic(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def mean_of_present(values: list[Column]) -> Column:
    """Row-wise mean of the non-NULL values."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    count = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.try_divide(total, count)


def season_sin(month: Column) -> Column:
    return F.sin(F.pi() / 6 * month)


def season_cos(month: Column) -> Column:
    return F.cos(F.pi() / 6 * month)


# ------------------------------------------------------------ null handling


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def usable_odds(odds: Column) -> Column:
    """Odds below 1 or missing become the default."""
    return F.when(odds >= 1, odds).otherwise(F.lit(fixed.DEFAULT_ODDS).cast("double"))


def payback_ratio(payback: Column) -> Column:
    """Payback per unit staked; none is 0."""
    return F.coalesce(payback, F.lit(0)) / 100


def payback_capped(payback: Column) -> Column:
    return clip(payback_ratio(payback), 0.0, 100.0)


def staked_return(payback: Column) -> Column:
    """Profit per unit staked."""
    return (F.coalesce(payback, F.lit(0)) - 100) / 100


# -------------------------------------------------------------------- flags


def present_flag(value: Column, kind: str = "int") -> Column:
    return value.isNotNull().cast(kind)


def missing_flag(value: Column) -> Column:
    """1 where the value is missing."""
    return value.isNull().cast("tinyint")


def equal_flag(left: Column, right: Column) -> Column:
    """1 where both are equal; 0 if either is missing."""
    return F.coalesce(left == right, F.lit(False)).cast("tinyint")


def value_flag(value: Column, wanted, kind: str = "int") -> Column:
    """1 where ``value`` is ``wanted``; missing counts as 0."""
    return F.coalesce(value == wanted, F.lit(False)).cast(kind)


def less_flag(left: Column, right: Column, kind: str = "int") -> Column:
    """1 where ``left < right``; missing counts as 0."""
    return F.coalesce(left < right, F.lit(False)).cast(kind)


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


# -------------------------------------------------------------------- codes


def distance_bucket(distance: Column) -> Column:
    """Distance class; NULL below the first range."""
    return (
        F.when(distance.between(1000, 1400), "sprint")
        .when((distance > 1400) & (distance <= 1600), "mile")
        .when((distance > 1600) & (distance <= 2200), "middle")
        .when((distance > 2200) & (distance < 2600), "classic")
        .when(distance >= 2600, "stayer")
    )


def class_of(code: Column, classes: Mapping[str, tuple[str, ...]], other: str) -> Column:
    """The class that lists the row's code; ``other`` for codes in none, also NULL."""
    result = F.when(F.lit(False), other)
    for name, codes in classes.items():
        result = result.when(code.isin(*codes), name)
    return result.otherwise(other)


def hoof_size(code: Column) -> Column:
    """Size class of a hoof code."""
    return class_of(code, fixed.HOOF_SIZES, fixed.OTHER_HOOF)


def hoof_type(code: Column) -> Column:
    """Type class of a hoof code."""
    return class_of(code, fixed.HOOF_TYPES, fixed.OTHER_HOOF)


def choose_by_code(code: Column, choices: Mapping[str, Column]) -> Column:
    """The column listed for the row's code; NULL for other codes."""
    result = None
    for value, column in choices.items():
        result = F.when(code == value, column) if result is None else result.when(code == value, column)
    return result


def recode(code: Column, value: str, to: str) -> Column:
    """One value replaced; everything else, also NULL, kept."""
    return F.when(code == value, F.lit(to)).otherwise(code)


def combined_code(left: Column, right: Column) -> Column:
    """Two codes joined; a blank ``s`` on either side wins, NULL propagates otherwise."""
    blank = F.coalesce(left == "s", F.lit(False)) | F.coalesce(right == "s", F.lit(False))
    return F.when(blank, F.lit("s")).otherwise(F.concat(left, right))


def text_key(*parts: Column) -> Column:
    """Parts as text joined by ``_``; NULL reads ``nan``."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("nan")) for p in parts])


# -------------------------------------------------------------------- dates


def code_date(value: Column) -> Column:
    """Date of a ``YYYYMMDDs`` string; NULL if it is not one."""
    return F.try_to_timestamp(value, F.lit("yyyyMMdd's'")).cast("date")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Days between two date strings; negative is NULL."""
    days = F.datediff(code_date(later), code_date(earlier)).cast("double")
    return F.when(days >= 0, days)


# ------------------------------------------------------------------- corners


def first_corner(*passes: Column) -> Column:
    """The first pass position that is neither missing nor zero."""
    return F.coalesce(*[zero_to_null(p) for p in passes])


# ------------------------------------------------------------ embedding width


def embedding_width(size: Column, steps: str = "divided") -> Column:
    """Embedding width for a code with ``size`` values.

    ``divided`` divides by a step-wise growing number; ``capped_10`` and
    ``capped_5`` keep sizes below 10 or 5 and use 10, then 20, above.
    """
    if steps == "divided":
        divisor = (
            F.when(size < 10, 2).when(size < 30, 5).when(size < 150, 10).when(size < 300, 15)
            .otherwise(50)
        )
        return (F.floor(size / divisor) + 1).cast("int")
    keep_below = {"capped_10": 10, "capped_5": 5}[steps]
    return F.when(size < keep_below, size).when(size < 20, 10).otherwise(20).cast("int")
