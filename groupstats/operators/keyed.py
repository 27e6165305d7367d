"""Statistics by a key that cuts across groups, such as distance or course."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupstats.functions import columns as fc
from groupstats.functions import fixed
from groupstats.operators.columns import slot_prefix, without_prefix
from groupstats.skew import Fitted, attach, attach_many, freeze


def fit_key_moments(df: DataFrame, key: str, values: Sequence[str]) -> Fitted:
    """Mean and deviation of each value per key."""
    stats = [F.avg(v).alias(f"_avg_{v}") for v in values]
    stats += [F.stddev_samp(v).alias(f"_std_{v}") for v in values]
    return freeze(df.filter(F.col(key).isNotNull()).groupBy(key).agg(*stats))


def by_key(
    df: DataFrame,
    key: str,
    zscores: dict[str, str],
    ratios: dict[str, str],
    fitted: Fitted | None = None,
) -> DataFrame:
    """Append z-scores (no floor) and ratios to the mean, both within ``key``.

    ``zscores`` and ``ratios`` map result names to value columns. Rows without
    a key drop out.
    """
    values = list(dict.fromkeys([*zscores.values(), *ratios.values()]))
    fitted = fitted or fit_key_moments(df, key, values)
    joined = attach(df, fitted, key)
    z = [
        fc.standard_score(F.col(v), F.col(f"_avg_{v}"), F.col(f"_std_{v}")).alias(n)
        for n, v in zscores.items()
    ]
    r = [F.try_divide(F.col(v), F.col(f"_avg_{v}")).alias(n) for n, v in ratios.items()]
    return joined.select(*df.columns, *z, *r)


def key_zscore(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return by_key(df, key, {name: value}, {})


def key_ratio(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return by_key(df, key, {}, {name: value})


def _slot_key(slot: str, parts: Sequence[str]):
    return fc.text_key(*[F.col(f"{slot}_{p}") for p in parts])


def fit_slot_scores(
    df: DataFrame,
    slots: Sequence[str] = tuple(fixed.SLOTS),
    keys: Sequence[Sequence[str]] = tuple(fixed.SLOT_KEYS),
    targets: Sequence[str] = tuple(fixed.SLOT_TARGETS),
) -> Fitted:
    """Moments of every slot and key set from one scan and one aggregation."""
    rows = [
        F.struct(
            F.lit(f"{slot}_{'_'.join(parts)}").alias("_slot"),
            _slot_key(slot, parts).alias("_key"),
            *[F.col(f"{slot}_{t}").alias(t) for t in targets],
        )
        for slot in slots
        for parts in keys
    ]
    stats = [F.avg(t).alias(f"_avg_{t}") for t in targets]
    stats += [F.stddev_samp(t).alias(f"_std_{t}") for t in targets]
    return freeze(
        df.select(F.inline(F.array(*rows))).groupBy("_slot", "_key").agg(*stats)
    )


def append_slot_scores(
    df: DataFrame,
    slots: Sequence[str] = tuple(fixed.SLOTS),
    keys: Sequence[Sequence[str]] = tuple(fixed.SLOT_KEYS),
    targets: Sequence[str] = tuple(fixed.SLOT_TARGETS),
    floor: float = fixed.SLOT_STD_FLOOR,
    fitted: Fitted | None = None,
) -> DataFrame:
    """z-score of each slot value among rows with the same slot key.

    The result ``<slot>_<target>_<key set>_tmp_score`` covers every slot, key
    set and target.
    """
    fitted = fitted or fit_slot_scores(df, slots, keys, targets)
    looked_up = {f"{slot}_{'_'.join(parts)}": _slot_key(slot, parts) for slot in slots for parts in keys}
    found = attach_many(df, fitted, "_slot", "_key", looked_up, "inner")
    scores = []
    for slot in slots:
        for parts in keys:
            label = "_".join(parts)
            got = F.col(f"`_got_{slot}_{label}`")
            for t in targets:
                z = fc.standard_score(F.col(f"{slot}_{t}"), got.getField(f"_avg_{t}"), got.getField(f"_std_{t}"), floor)
                scores.append(z.alias(slot_score_name(f"{slot}_{t}", f"{slot}_{label}_tmp")))
    return found.select(*df.columns, *scores)


def slot_score_name(target: str, key: str) -> str:
    """``pre1_Time`` scored by ``pre1_Distance_tmp`` is ``pre1_Time_Distance_tmp_score``."""
    return f"{slot_prefix(key)}_{without_prefix(target)}_{without_prefix(key)}_score"
