"""Label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupstats.functions import columns as fc
from groupstats.operators.groups import append_margin
from groupstats.operators.keyed import by_key
from groupstats.operators.ranks import append_popularity
from groupstats.skew import Heavy


def append_returns(
    df: DataFrame,
    win: str = "hr_PaybackWin",
    place: str = "hr_PaybackPlace",
    place_return_of: str | None = None,
) -> DataFrame:
    """Win and place flags, and returns per unit staked.

    ``place_return`` is computed from the win payback unless another column is
    named.
    """
    return df.withColumns(
        {
            "is_win": fc.present_flag(F.col(win)),
            "is_place": fc.present_flag(F.col(place)),
            "win_return": fc.staked_return(F.col(win)),
            "place_return": fc.staked_return(F.col(place_return_of or win)),
        }
    )


def append_crowd_flags(
    df: DataFrame, finish: str = "hr_OrderOfFinish", popularity: str = "pops_order"
) -> DataFrame:
    """Did the entry finish better than its popularity, and did it also place."""
    better = fc.less_flag(F.col(finish), F.col(popularity))
    return df.withColumns({"oof_over_pops": better, "pop_prediction": better * F.col("is_place")})


def append_targets(
    df: DataFrame,
    group: str = "hi_RaceID",
    time: str = "hr_FinishingTime",
    distance: str = "hr_Distance",
    entry: str | list[str] | None = None,
    odds: str = "li_WinOdds",
    finish: str = "hr_OrderOfFinish",
    win: str = "hr_PaybackWin",
    place: str = "hr_PaybackPlace",
    place_return_of: str | None = None,
    heavy: Heavy | None = None,
) -> DataFrame:
    """Margin, win and place labels, and time and margin scaled within the distance.

    With ``entry`` (the unique id that breaks ties) the popularity order and
    the flags built on it come too.
    """
    df = append_returns(df, win, place, place_return_of)
    if entry is not None:
        df = append_popularity(df, group, odds, entry, heavy=heavy)
        df = append_crowd_flags(df, finish)
    df = append_margin(df, group, time, heavy=heavy)
    return by_key(
        df,
        distance,
        {"norm_margin": "margin", "norm_time": time},
        {"div_margin": "margin", "div_time": time},
    )


def append_order_targets(
    df: DataFrame,
    finish: str = "hr_OrderOfFinish",
    popularity: str = "hi_BasePops",
    win: str = "hr_PaybackWin",
    place: str = "hr_PaybackPlace",
    place_return_of: str | None = None,
) -> DataFrame:
    """The same labels with winning read from the order of finish."""
    df = append_returns(df, win, place, place_return_of)
    df = df.withColumn("is_win", fc.value_flag(F.col(finish), 1))
    return append_crowd_flags(df, finish, popularity)
