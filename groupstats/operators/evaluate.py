"""Group-wise evaluation reports. Each returns a small DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from groupstats.functions import columns as fc
from groupstats.functions import fixed
from groupstats.operators.groups import leave_one_out
from groupstats.operators.ranks import best_of_group
from groupstats.skew import Heavy, as_list

SMALLEST_PROBABILITY = 1e-8


def _hits_and_returns(flag: Column, payback: Column, picked: Column, stakes: Column, name: str) -> list[Column]:
    hits = F.sum(F.when(picked, flag).otherwise(0))
    paid = F.sum(F.when(picked, F.coalesce(payback, F.lit(0.0))).otherwise(0.0))
    return [
        F.try_divide(hits, stakes).alias(f"{name}_hit"),
        F.try_divide(paid, stakes * 100).alias(f"{name}_return"),
    ]


def top1_report(
    df: DataFrame,
    group: str,
    entry: str | Sequence[str],
    pred: str = "pred",
    mode: str = "argmax",
    win: str = "hr_PaybackWin",
    place: str = "hr_PaybackPlace",
) -> DataFrame:
    """Hit ratio and return of betting each group's pick, to win and to place."""
    picks = best_of_group(df, group, pred, entry, mode, ["is_win", "is_place", win, place])
    every, groups = F.lit(True), F.count(F.lit(1))
    return picks.agg(
        groups.alias("groups"),
        *_hits_and_returns(F.col("is_win"), F.col(win), every, groups, "win"),
        *_hits_and_returns(F.col("is_place"), F.col(place), every, groups, "place"),
    )


def value_bet_report(
    df: DataFrame,
    group: str,
    entry: str | Sequence[str],
    pred: str = "pred",
    mode: str = "argmax",
    win: str = "hr_PaybackWin",
    place: str = "hr_PaybackPlace",
    value: str = "kaime",
) -> DataFrame:
    """The same over picks the model ranks ahead of the crowd, per such pick."""
    picks = best_of_group(df, group, pred, entry, mode, ["is_win", "is_place", win, place, value])
    bought = F.coalesce(F.col(value) == 1, F.lit(False))
    buys = F.count_if(bought)
    return picks.agg(
        buys.alias("buys"),
        *_hits_and_returns(F.col("is_win"), F.col(win), bought, buys, "win"),
        *_hits_and_returns(F.col("is_place"), F.col(place), bought, buys, "place"),
    )


def fold_summary(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return scores.agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics],
    )


def threshold_sweep(
    df: DataFrame,
    pred: str = "pred",
    win: str = "hr_PaybackWin",
    place: str = "hr_PaybackPlace",
    steps: int = fixed.SWEEP_STEPS,
) -> DataFrame:
    """Buys, hits and returns when buying above each of ``steps`` cutoffs in [0, 1).

    Rows are summed once by the number of cutoffs they pass; a running sum over
    these ``steps + 1`` totals then gives every cutoff.
    """
    step = F.ceil(F.col(pred) * steps).cast("long")
    # division and multiplication can round differently next to a cutoff
    step = step + F.when(F.col(pred) > step / steps, 1).otherwise(0) - F.when(
        F.col(pred) <= (step - 1) / steps, 1
    ).otherwise(0)
    passed = F.least(F.greatest(step, F.lit(0)), F.lit(steps)).cast("int")
    totals = (
        df.filter(F.col(pred).isNotNull())
        .groupBy(passed.alias("_passed"))
        .agg(
            F.count(F.lit(1)).alias("_buys"),
            F.sum("is_win").alias("_win"),
            F.sum(F.coalesce(win, F.lit(0.0))).alias("_win_paid"),
            F.sum("is_place").alias("_place"),
            F.sum(F.coalesce(place, F.lit(0.0))).alias("_place_paid"),
            F.min(pred).alias("_min"),
            F.max(pred).alias("_max"),
        )
    )
    numbers = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("_passed"))
    full = numbers.join(totals, "_passed", "left")
    above = Window.orderBy(F.desc("_passed")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("_passed")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c).over(above), F.lit(0))

    swept = full.select(
        (F.col("_passed") / steps).alias("cutoff"),
        "_passed",
        total("_buys").alias("buys"),
        *[total(c).alias(c) for c in ("_win", "_win_paid", "_place", "_place_paid")],
        F.min("_min").over(every).alias("min_pred"),
        F.max("_max").over(every).alias("max_pred"),
    ).filter(F.col("_passed") < steps)
    return swept.select(
        "cutoff",
        "buys",
        F.try_divide("_win", "buys").alias("win_hit"),
        F.try_divide(F.col("_win_paid"), F.col("buys") * 100).alias("win_return"),
        F.try_divide("_place", "buys").alias("place_hit"),
        F.try_divide(F.col("_place_paid"), F.col("buys") * 100).alias("place_return"),
        "min_pred",
        "max_pred",
    )


def buy_skip_report(df: DataFrame, p_skip: str = "p_skip", p_buy: str = "p_buy", payoff: str = "y") -> DataFrame:
    """Hit and return per buy, buying where buying is at least as likely as skipping."""
    bought = F.coalesce(F.col(p_buy) >= F.col(p_skip), F.lit(False))
    buys = F.count_if(bought)
    hits = F.sum(F.when(bought, fc.clip(F.col(payoff), 0.0, 1.0)).otherwise(0.0))
    paid = F.sum(F.when(bought, F.col(payoff)).otherwise(0.0))
    return df.agg(
        buys.alias("buys"),
        F.count(F.lit(1)).alias("entries"),
        F.try_divide(hits, buys).alias("hit_ratio"),
        F.try_divide(paid, buys).alias("return_ratio"),
    )


def argmax_hit(df: DataFrame, group: str, entry: str | Sequence[str], pred: str, label: str) -> DataFrame:
    """Share of groups where the entry with the largest prediction has the largest label."""
    hit = by_group_hit(df, group, entry, pred, label)
    return hit.agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col("hit").cast("double")).alias("hit_ratio"))


def by_group_hit(df: DataFrame, group: str, entry: str | Sequence[str], pred: str, label: str) -> DataFrame:
    """Per group: do prediction and label have their largest value at the same entry."""
    ties = [F.col(e) for e in as_list(entry)]
    ids = F.struct(*ties)

    def first_best(c: str) -> Column:
        order = F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("s"), *ties))
        return F.min_by(ids, order)

    grouped = df.filter(F.col(group).isNotNull()).groupBy(group)
    return grouped.agg(
        F.coalesce(first_best(pred) == first_best(label), F.lit(False)).cast("int").alias("hit")
    )


def winner_accuracy(
    df: DataFrame, group: str, entry: str | Sequence[str], pred: str, margin: str = "margin"
) -> DataFrame:
    """Share of groups whose smallest prediction belongs to an entry with margin 0."""
    picks = best_of_group(df, group, pred, entry, "argmin", [margin])
    right = F.coalesce(F.col(margin) == 0, F.lit(False)).cast("double")
    return picks.agg(F.count(F.lit(1)).alias("groups"), F.avg(right).alias("accuracy"))


# ------------------------------------------------------------ pairwise losses

#: Entries of a stripe at most, when its blocks are narrower: two stripes make a cell of the grid of pairs.
STRIPE = 1024
#: Pairs worked out at once: their arrays stay in a core's cache.
PAIRS_AT_ONCE = 1 << 15


def _softplus(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``log(1 + exp(x))`` and ``log(1 + exp(-x))`` from one exponential and one logarithm, without overflow."""
    shared = np.log(1.0 + np.exp(-np.abs(x)))
    return np.maximum(x, 0.0) + shared, np.maximum(-x, 0.0) + shared


def _entropy(pred_gap: np.ndarray, label_gap: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Cross-entropy of the order of two entries; the same whichever comes first."""
    highest = -math.log(SMALLEST_PROBABILITY)
    small = np.exp(-np.abs(label_gap))
    first = np.where(label_gap < 0, small, 1.0) / (1.0 + small)
    second_loss, first_loss = _softplus(pred_gap)
    return first * np.minimum(first_loss, highest) + (1 - first) * np.minimum(second_loss, highest)


def _clipped(pred_gap: np.ndarray, label_gap: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Both orders of two entries."""
    product = np.tanh(label_gap)
    up, down = _softplus(pred_gap)
    return np.clip(width + up * product, 0.0, width) + np.clip(width - down * product, 0.0, width)


def _pair_sums(term, width: np.ndarray, a: tuple, b: tuple | None) -> np.ndarray:
    """Per row: ``term`` over the pairs of the entries of ``a``, or of an entry of ``a`` with one of ``b``.

    ``a`` and ``b`` are (rows, entries) arrays of predictions and labels.
    """
    rows, n = a[0].shape
    if b is None:
        left, right = np.triu_indices(n, 1)
        b = a
    else:
        left, right = (i.ravel() for i in np.indices((n, b[0].shape[1])))
    out = np.zeros(rows)
    for at in range(0, len(left), PAIRS_AT_ONCE):
        i, j = left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE]
        step = max(1, PAIRS_AT_ONCE // max(1, len(i)))
        for row in range(0, rows, step):
            some = slice(row, row + step)
            out[some] += term(b[0][some][:, j] - a[0][some][:, i], b[1][some][:, j] - a[1][some][:, i], width[some, None]).sum(axis=1)
    return out


def _matrices(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows whose list columns have the same lengths, with these columns as matrices."""
    columns = [batch.column(n) for n in names]
    offsets = [c.offsets.to_numpy() for c in columns]
    flat = [c.values.to_numpy(zero_copy_only=False) for c in columns]
    sizes = np.stack([np.diff(o) for o in offsets])
    kinds, which = np.unique(sizes, axis=1, return_inverse=True)
    for kind in range(kinds.shape[1]):
        rows = np.flatnonzero(which.ravel() == kind)
        yield rows, [v[o[rows][:, None] + np.arange(n)] for v, o, n in zip(flat, offsets, kinds[:, kind])]


def _pair_loss(tensors: DataFrame, group: str, pred: str, label: str, term, alone) -> DataFrame:
    """``(group, _width, _total)``: sum of ``term`` over all pairs of a group and of ``alone(width)`` over its entries.

    Blocks are laid together to stripes of up to ``STRIPE`` entries. A task works out the pairs inside a stripe; only stripes of
    groups that have several go on, each to the cells of the grid in which it meets the others. So the pairs of
    a group of any size are spread by cell, and no task holds more than two stripes.
    """
    whole = "block" not in tensors.columns
    rows = tensors.select(
        group,
        *([F.lit(0).alias("block"), F.lit(1).alias("blocks")] if whole else ["block", *(["blocks"] if "blocks" in tensors.columns else [])]),
        F.size(pred).alias("_size"), F.col(pred).cast("array<double>").alias("_p"), F.col(label).cast("array<double>").alias("_t"),
    )
    if "blocks" not in rows.columns:
        counts = tensors.groupBy(group).agg((F.max("block") + 1).alias("blocks"))
        rows = rows.join(counts, group)
    if whole:
        stripes = rows.select(group, F.lit(0).alias("_stripe"), F.lit(1).alias("_stripes"), F.col("_size").alias("_width"), "_p", "_t")
    else:
        per_stripe = F.greatest(F.lit(1), F.floor(F.lit(STRIPE) / F.greatest(F.col("_size"), F.lit(1))))
        rows = rows.withColumn("_per", per_stripe)
        collected = rows.groupBy(group, F.floor(F.col("block") / F.col("_per")).cast("int").alias("_stripe")).agg(
            F.collect_list(F.struct("_p", "_t")).alias("_rows"),
            F.first(F.ceil(F.col("blocks") / F.col("_per")).cast("int")).alias("_stripes"),
            F.first(F.col("_size") * F.col("blocks")).alias("_width"),
        )
        stripes = collected.select(
            group, "_stripe", "_stripes", "_width", F.flatten("_rows._p").alias("_p"), F.flatten("_rows._t").alias("_t")
        )

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            width = batch.column("_width").to_numpy().astype(np.float64)
            for at, (p, t) in _matrices(batch, ["_p", "_t"]):
                total[at] = _pair_sums(term, width[at], (p, t), None) + p.shape[1] * alone(width[at])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(total, mask=np.isnan(total))], [*batch.schema.names, "_total"]
            )

    summed = stripes.mapInArrow(inside, StructType([*stripes.schema.fields, StructField("_total", DoubleType())]))
    if whole:
        return summed.select(group, "_width", "_total")

    met = summed.select("*", F.explode(F.sequence(F.lit(0), F.col("_stripes") - 1)).alias("_other"))
    own, held = F.col("_stripe") == F.col("_other"), F.struct("_p", "_t")
    cells = met.groupBy(group, F.least("_stripe", "_other").alias("_a"), F.greatest("_stripe", "_other").alias("_b")).agg(
        F.first("_width").alias("_width"),
        F.first(F.when(own, F.col("_total")), True).alias("_total"),
        F.max(own & F.col("_total").isNull()).alias("_missing"),
        F.first(F.when(F.col("_stripe") < F.col("_other"), held), True).alias("_left"),
        F.first(F.when(F.col("_stripe") > F.col("_other"), held), True).alias("_right"),
    )
    none = F.array().cast("array<double>")
    cells = cells.select(
        group, "_width", F.when(~F.col("_missing"), F.coalesce("_total", F.lit(0.0))).alias("_total"),
        *[F.coalesce(f"{side}.{c}", none).alias(f"{side}{c}") for side in ("_left", "_right") for c in ("_p", "_t")],
    )

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("_total").to_numpy(zero_copy_only=False).copy()
            width = batch.column("_width").to_numpy().astype(np.float64)
            for at, (p, t, q, u) in _matrices(batch, ["_left_p", "_left_t", "_right_p", "_right_t"]):
                if p.shape[1]:
                    total[at] += _pair_sums(term, width[at], (p, t), (q, u))
            kept = batch.select([group, "_width"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(total, mask=np.isnan(total))], [group, "_width", "_total"])

    schema = StructType([cells.schema[group], cells.schema["_width"], StructField("_total", DoubleType())])
    parts = cells.mapInArrow(between, schema)
    return parts.groupBy(group).agg(
        F.first("_width").alias("_width"), F.when(F.count("_total") == F.count(F.lit(1)), F.sum("_total")).alias("_total")
    )


def pairwise_cross_entropy(tensors: DataFrame, group: str, pred: str, label: str) -> DataFrame:
    """Per group: cross-entropy of the order of each pair ``i < j``, by the width.

    Works on the arrays of padded groups: one row per group, or rows numbered ``block``, whose pairs between blocks count as
    well; the width is that of all blocks. A missing value makes the group's loss NULL.
    """
    sums = _pair_loss(tensors, group, pred, label, _entropy, lambda width: 0.0)
    return sums.select(group, F.try_divide("_total", F.col("_width").cast("double")).alias("loss"))


def pairwise_softplus(tensors: DataFrame, group: str, pred: str, label: str) -> DataFrame:
    """Per group: sum over ordered pairs of ``clip(w + softplus(dy) * tanh(dt), 0, w) / w^2``.

    Rows and missing values are those of :func:`pairwise_cross_entropy`.
    """
    sums = _pair_loss(tensors, group, pred, label, _clipped, lambda width: width)
    width = F.col("_width").cast("double")
    return sums.select(group, F.try_divide("_total", width * width).alias("loss"))


# ------------------------------------------------------------- cross entropy


def _probability(p: Column) -> Column:
    return F.greatest(p, F.lit(SMALLEST_PROBABILITY))


def cross_entropy(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Mean cross-entropy of a 0..1 label, and the mean reward-weighted log probability."""
    y, p = F.col(label), F.col(probability)
    both = -y * F.log(_probability(p)) - (1 - y) * F.log(_probability(1 - p))
    weighted = -y * F.log(F.least(_probability(p), F.lit(1.0)))
    return df.agg(F.avg(both).alias("cross_entropy"), F.avg(weighted).alias("log_loss"))


# ---------------------------------------------------------- leave-one-out reward


def append_rewards(
    df: DataFrame,
    group: str,
    payoff: str = "y",
    buy: str = "buy",
    limit: float = fixed.REWARD_LIMIT,
    heavy: Heavy | None = None,
) -> DataFrame:
    """Reward of skipping or buying an entry given what was done with the others.

    Each other entry adds its payoff if bought and 1 if not. A reward above
    ``limit`` gains 1, then the mean of both is taken off.
    """
    spread = df.withColumn("_kept", F.when(F.col(buy) == 1, F.col(payoff)).otherwise(1.0))
    rest = leave_one_out(spread, group, {"_others": "_kept"}, "_n", heavy)
    entries = F.col("_n") + 1

    def reward(own: Column) -> Column:
        raw = own + F.col("_others") - entries
        return raw + F.when(raw > limit, 1.0).otherwise(0.0)

    rest = rest.select(*df.columns, reward(F.lit(1.0)).alias("_skip"), reward(F.col(payoff)).alias("_buy"))
    mean = (F.col("_skip") + F.col("_buy")) / 2
    return rest.select(
        *df.columns, (F.col("_skip") - mean).alias("reward_skip"), (F.col("_buy") - mean).alias("reward_buy")
    )
