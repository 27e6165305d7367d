"""The three end-to-end runs over the entry table, as staged runs.

``entry`` is the unique id of an entry; it is carried along and never a
feature. Column names are those of the entry table. Heavy groups are looked
for once per run, on the input: later stages only take rows away.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupstats.functions import columns as fc
from groupstats.functions import fixed
from groupstats.operators import (
    columns, encode, features, filters, groups, keyed, models, nulls, ranks, reshape, scaling, splits, targets,
)
from groupstats.plans.stages import StagedRun
from groupstats.skew import find_heavy

GROUP = "hi_RaceID"
COMBINED_ENTRY_CODES = ("hi_RunningStyle", "hi_SexCode")
COMBINED_GROUP_CODES = ("ri_Discipline",)


def _features(df: DataFrame, codes: Iterable[str], keys: Sequence[str]) -> tuple[list[str], list[str]]:
    """Code columns and numeric columns of ``df``, without keys."""
    every, numbers = columns.codes_and_numbers(df, codes)
    skip = {*keys}
    return [c for c in every if c not in skip], [c for c in numbers if c not in skip]


def _shared_preparation(df: DataFrame) -> DataFrame:
    df = features.append_equal_flags(df)
    df = features.append_elapsed_days(df)
    df = features.append_parent_rates(df)
    return features.append_combined_codes(df, COMBINED_ENTRY_CODES, COMBINED_GROUP_CODES)


# ------------------------------------------------------------ boosted-tree run


def boosted_tree_rows(
    df: DataFrame,
    folder: str,
    entry: str,
    codes: Sequence[str],
    removes: Sequence[str] = (),
    category: str = "sprint",
    keep_above: int = fixed.KEEP_ABOVE,
) -> DataFrame:
    """Training rows of the tree models: targets, encoded codes, features."""
    codes = [*codes, *fixed.DERIVED_CODES]
    keys = [GROUP, entry]
    heavy = find_heavy(df, GROUP)

    def prepare(df: DataFrame) -> DataFrame:
        df = filters.without_codes(df, "hi_ConditionClass")
        df = filters.only_code(features.append_classes(df), "distance_category", category)
        df = ranks.append_popularity(df, GROUP, entry=entry, heavy=heavy)
        df = targets.append_targets(df, heavy=heavy)
        df = df.withColumn("hi_RunningStyle", fc.recode(F.col("hi_RunningStyle"), "8s", "s"))
        return _shared_preparation(groups.append_code_shares(df, GROUP, heavy=heavy))

    def text_codes(df: DataFrame) -> list[str]:
        return _features(df, codes, keys)[0]

    def engineer(df: DataFrame) -> DataFrame:
        df = features.append_log_deltas(
            df, {f"pre{i}_TimeDelta": f"per{i}_log_delta" for i in (1, 2, 3)}
        )
        df = features.append_corners(keyed.append_slot_scores(features.append_ratios(df)))
        df = features.append_deltas(features.roll_up_career(df))
        df = features.summarise_slots(df, codes)
        df = groups.append_group_zscore(df, GROUP, _features(df, codes, keys)[1], heavy=heavy)
        return encode.encode_pairs(df)

    run = StagedRun(folder)
    run.add(prepare, name="preprocess")
    run.add(lambda df: encode.fold_others(df, text_codes(df), GROUP, keep_above), name="replace_few")
    run.add(lambda df: encode.label_encode(df, text_codes(df)), name="labels")
    run.add(columns.drop_listed, {"columns": [c for c in removes if c not in keys]}, name="remove")
    run.add(engineer, name="features")
    run.add(groups.drop_groups_without, {"group": GROUP, "heavy": heavy}, name="complete_groups")
    rows = filters.with_label(run.fit_gene(columns.sort_columns(df)), ["margin"])
    return rows.withColumn("margin", fc.log_shifted(F.col("margin")))


def boosted_tree_run(
    rows: DataFrame, entry: str, folds: int = 10, target: str = "margin", params: dict | None = None
) -> tuple[DataFrame, DataFrame, PipelineModel, DataFrame]:
    """Fold scores, their summary, and the first fold's model with its scored test rows."""
    rows = splits.append_group_fold(rows, GROUP, folds)
    guards = [*fixed.PROCESS_FEATURES, entry, "fold"]
    inputs = [c for c in columns.feature_names(rows, guards) if dict(rows.dtypes)[c] != "string"]
    job = models.Boosting(inputs, target, params=params)
    scores, summary = models.fit_folds(rows, job, folds, GROUP, entry)
    train, test = splits.fold_frames(rows, 0)
    model = models.fit_boosting(train, job, test)
    return scores, summary, model, models.score(model, test)


# ------------------------------------------------------------------- tensor run


def tensor_groups(
    df: DataFrame,
    folder: str,
    entry: str,
    codes: Sequence[str],
    removes: Sequence[str] = (),
    years: Iterable[int] | None = range(2011, 2019),
    target: str = "margin",
    split_year: int = 2017,
    few_below: int = fixed.FEW_BELOW,
) -> tuple[DataFrame, DataFrame]:
    """Training and test groups as fixed-width arrays."""
    codes = [*codes, *fixed.DERIVED_CODES]
    keys = [GROUP, entry]
    heavy = find_heavy(df, GROUP)

    def prepare(df: DataFrame) -> DataFrame:
        df = filters.with_label(df, [GROUP, "hr_OrderOfFinish"], nonzero=["hr_OrderOfFinish"])
        df = filters.without_codes(targets.append_targets(df, heavy=heavy), "hi_ConditionClass")
        df = _shared_preparation(features.append_classes(df))
        return groups.append_code_shares(df, GROUP, heavy=heavy)

    def fill(df: DataFrame) -> DataFrame:
        text, numbers = _features(df, codes, keys)
        numbers = [c for c in numbers if c not in fixed.PROCESS_FEATURES]
        text = [c for c in text if dict(df.dtypes)[c] == "string"]
        return nulls.fill_group(df, GROUP, numbers, text, heavy=heavy)

    def labels(df: DataFrame) -> DataFrame:
        text = _features(df, codes, keys)[0]
        df = columns.cast_columns(df, text, "string")
        return encode.label_encode(encode.fold_few(df, text, GROUP, few_below), text)

    def engineer(df: DataFrame) -> DataFrame:
        df = features.append_corners(features.append_ratios(df))
        df = features.append_deltas(features.roll_up_career(df))
        return groups.append_group_zscore(df, GROUP, _features(df, codes, keys)[1], heavy=heavy)

    def normalize(df: DataFrame) -> DataFrame:
        numbers = [c for c in _features(df, codes, keys)[1] if c not in fixed.PROCESS_FEATURES]
        return scaling.normalize(df, numbers).fillna(0)

    run = StagedRun(folder)
    run.add(prepare, name="preprocess")
    run.add(fill, name="fillna")
    run.add(labels, name="labels")
    run.add(columns.choose_columns, {"remove": [c for c in removes if c not in keys]}, name="remove")
    run.add(filters.only_years, {"years": years}, name="years")
    run.add(engineer, name="features")
    run.add(normalize, name="normalize")
    rows = run.fit_gene(df)

    text, numbers = _features(rows, codes, keys)
    inputs = [c for c in numbers if c not in fixed.PROCESS_FEATURES]
    constants = {"hr_OrderOfFinish": fixed.PADDED_FINISH, "is_win": 0, "is_place": 0}
    padded = reshape.pad_groups(
        rows, GROUP, entry, [*dict.fromkeys([*inputs, target, "ri_Year"])], text, constants, seed=fixed.FOLD_SEED
    )
    return tuple(
        reshape.to_tensors(part, GROUP, inputs, text, [target])
        for part in splits.split_by_year(padded, split_year)
    )


# --------------------------------------------------------------- buy/skip run


def policy_groups(
    df: DataFrame,
    folder: str,
    entry: str,
    codes: Sequence[str],
    removes: Sequence[str] = (),
    since: int = 2007,
    split_year: int = 2017,
    target: str = "hr_PaybackPlace",
    few_below: int = fixed.FEW_BELOW,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, test rows and code sizes of the buy/skip policy."""
    keys = [GROUP, entry]
    heavy = find_heavy(df, GROUP)

    def prepare(df: DataFrame) -> DataFrame:
        df = features.append_missing_flags(nulls.null_count(df))
        df = groups.append_code_shares(features.roll_up_career(df), GROUP, heavy=heavy)
        return features.append_deltas(features.append_corners(features.append_elapsed_days(df)))

    def fill(df: DataFrame) -> DataFrame:
        df = nulls.scale_paybacks(df)
        text, numbers = _features(df, codes, keys)
        return nulls.fill_global(df, [c for c in numbers if "Payback" not in c], text)

    def labels(df: DataFrame) -> DataFrame:
        text = _features(df, codes, keys)[0]
        return columns.shrink_codes(
            encode.label_encode(encode.fold_few(df, text, GROUP, few_below), text), text
        )

    def normalize(df: DataFrame) -> DataFrame:
        text = _features(df, codes, keys)[0]
        return groups.mixed_normalize(df, GROUP, [*text, entry], heavy=heavy)

    run = StagedRun(folder)
    run.add(prepare, name="preprocess1")
    run.add(fill, name="fillna")
    run.add(labels, name="labels")
    run.add(features.append_season, name="preprocess2")
    run.add(normalize, name="normalize")
    run.add(columns.drop_or_keep, {"remove": [c for c in removes if c not in keys]}, name="drop")
    rows = run.fit_gene(filters.from_year(df, since))
    parts = splits.split_by_year(rows, split_year)
    sizes = encode.embedding_widths(encode.max_codes(parts, _features(rows, codes, keys)[0]))
    train, test = (groups.drop_groups_zero_sum(p, GROUP, target, heavy) for p in parts)
    return train, test, sizes
