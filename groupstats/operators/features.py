"""Derived feature columns of an entry."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupstats.functions import columns as fc
from groupstats.functions import fixed
from groupstats.operators.columns import without_prefix

Pairs = Sequence[tuple[str, str, str]]


def append_classes(
    df: DataFrame, distance: str = "ri_Distance", hoof: str = "hi_HoofCode"
) -> DataFrame:
    """Distance class, hoof type and hoof size; the hoof code is dropped."""
    return df.withColumns(
        {
            "distance_category": fc.distance_bucket(F.col(distance)),
            "hoof_type": fc.hoof_type(F.col(hoof)),
            "hoof_size": fc.hoof_size(F.col(hoof)),
        }
    ).drop(hoof)


def append_parent_rates(df: DataFrame, surface: str = "ri_Discipline") -> DataFrame:
    """Parents' rates on the surface of the race."""
    rates = {
        f"{parent.lower()}_surf_winper": fc.choose_by_code(
            F.col(surface),
            {
                "1s": F.col(f"ei_{parent}TurfQuinellaPer"),
                "2s": F.col(f"ei_{parent}DirtQuinellaPer"),
            },
        )
        for parent in ("Father", "Mother")
    }
    return df.withColumns(rates)


def append_equal_flags(df: DataFrame, pairs: Pairs = tuple(fixed.CHANGE_PAIRS)) -> DataFrame:
    """1 where the two columns are equal (the columns are nevertheless called changes)."""
    return df.withColumns({n: fc.equal_flag(F.col(a), F.col(b)) for a, b, n in pairs})


def append_deltas(df: DataFrame, pairs: Pairs = tuple(fixed.DELTA_PAIRS)) -> DataFrame:
    return df.withColumns({n: F.col(a) - F.col(b) for a, b, n in pairs})


def append_missing_flags(
    df: DataFrame, flags: Mapping[str, str] = fixed.PRESENCE_FLAGS
) -> DataFrame:
    """1 where the id is missing (the columns are nevertheless called has_...)."""
    return df.withColumns({n: fc.missing_flag(F.col(c)) for c, n in flags.items()})


def append_elapsed_days(df: DataFrame, pairs: Pairs = tuple(fixed.DATE_PAIRS)) -> DataFrame:
    """Days between date strings; the date columns are dropped."""
    dates = {c for a, b, _ in pairs for c in (a, b)}
    return df.withColumns(
        {n: fc.elapsed_days(F.col(a), F.col(b)) for a, b, n in pairs}
    ).drop(*dates)


def append_ratios(df: DataFrame, slots: Sequence[str] = tuple(fixed.SLOTS)) -> DataFrame:
    """Speed and finish ratio of each slot whose columns are there."""
    recipes = [("Speed", "FinishingTime", "Distance"), ("OofRatio", "OrderOfFinish", "HeadCount")]
    have = set(df.columns)
    ratios = {
        f"{s}_{name}": F.try_divide(F.col(f"{s}_{top}"), F.col(f"{s}_{bottom}"))
        for name, top, bottom in recipes
        for s in slots
        if {f"{s}_{top}", f"{s}_{bottom}"} <= have
    }
    return df.withColumns(ratios) if ratios else df


def append_corners(df: DataFrame, slots: Sequence[str] = tuple(fixed.SLOTS)) -> DataFrame:
    """First corner position of each slot and the change to the last corner."""
    corners: dict[str, Column] = {}
    for s in slots:
        first = fc.first_corner(*[F.col(f"{s}_Pass{i}") for i in (1, 2, 3)])
        corners[f"first_corner_pass_{s}"] = first
        corners[f"first_last_pass_delta_{s}"] = F.col(f"{s}_Pass4") - first
    return df.withColumns(corners)


def append_season(df: DataFrame, month: str = "ri_Month") -> DataFrame:
    return df.withColumns(
        {"season_sin": fc.season_sin(F.col(month)), "season_cos": fc.season_cos(F.col(month))}
    )


def append_log_deltas(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``log(1 + x)`` of each listed column under a new name."""
    return df.withColumns({n: fc.log_shifted(F.col(c)) for c, n in names.items()})


def append_combined_codes(
    df: DataFrame, entry_codes: Sequence[str], group_codes: Sequence[str]
) -> DataFrame:
    """Every entry code joined with every group code."""

    def short(name: str) -> str:
        return name if name == name.lower() else name.split("_")[1].lower()

    return df.withColumns(
        {
            f"{short(a)}_{short(b)}": fc.combined_code(F.col(a), F.col(b))
            for a in entry_codes
            for b in group_codes
        }
    )


def roll_up_career(
    df: DataFrame,
    families: Sequence[str] = tuple(fixed.CAREER_FAMILIES),
    total_of: Sequence[str] = tuple(fixed.CAREER_TOTAL_OF),
    prefix: str = "ei",
) -> DataFrame:
    """Totals and rates of each family's first/second/third/lose counts.

    A family missing any of its four counts is left alone. Second and third
    are dropped, and the families in ``total_of`` are summed into one total
    and lose their own columns except the lose count and its rate.
    """
    have = set(df.columns)
    added: dict[str, Column] = {}
    dropped: list[str] = []

    def name(family: str, what: str) -> str:
        return f"{prefix}_{family}{what}"

    def sums(family: str) -> tuple[Column, Column, Column]:
        first, second, third, lose = (
            F.col(name(family, w)) for w in ("First", "Second", "Third", "Lose")
        )
        place = first + second + third
        return first, place, place + lose

    for family in dict.fromkeys(families):
        if not {name(family, w) for w in ("First", "Second", "Third", "Lose")} <= have:
            continue
        first, place, total = sums(family)
        added[name(family, "Total")] = total
        added[name(family, "Place")] = place
        added[name(family, "WinPer")] = F.try_divide(first, total)
        added[name(family, "PlacePer")] = F.try_divide(place, total)
        added[name(family, "LosePer")] = F.try_divide(F.col(name(family, "Lose")), total)
        dropped += [name(family, "Second"), name(family, "Third")]

    parts = [sums(f) for f in total_of]
    wins, places, totals = (sum(p[1:], p[0]) for p in zip(*parts))
    added[name("Total", "Total")] = totals
    added[name("Total", "Win")] = wins
    added[name("Total", "Place")] = places
    added[name("Total", "WinPer")] = F.try_divide(wins, totals)
    added[name("Total", "PlacePer")] = F.try_divide(places, totals)
    dropped += [
        name(f, w) for f in total_of for w in ("Total", "First", "Place", "WinPer", "PlacePer")
    ]
    return df.withColumns(added).drop(*dropped)


def summarise_slots(
    df: DataFrame, codes: Iterable[str] = (), slots: Sequence[str] = tuple(fixed.SLOTS)
) -> DataFrame:
    """Mean, min and max over the slots of every numeric slot column.

    Only the first slot's own columns stay.
    """
    codes = set(codes)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    first = slots[0] + "_"
    names = [
        without_prefix(c) for c in df.columns
        if c.startswith(first) and c in numeric and c not in codes
    ]
    added: dict[str, Column] = {}
    for n in names:
        values = [F.col(f"{s}_{n}") for s in slots]
        added[f"avg3_{n}"] = fc.mean_of_present(values)
        added[f"min3_{n}"] = F.least(*values)
        added[f"max3_{n}"] = F.greatest(*values)
    return df.withColumns(added).drop(*[f"{s}_{n}" for s in slots[1:] for n in names])
