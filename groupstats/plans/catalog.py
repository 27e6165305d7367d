"""One query per operator over the test tables: ``QUERIES[name](spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupstats.functions import columns as fc
from groupstats.operators import (
    columns, encode, evaluate, features, filters, groups, keyed, models, nulls, profiles, ranks, reshape, scaling,
    splits, targets,
)
from groupstats.plans import fitted
from groupstats.plans.views import ENTRY, GROUP, careers, entries, heavy_orders, rounded, slots, table
from groupstats.session import shared_folder, stored
from groupstats.skew import split
from groupstats.sources import files, schema
from groupstats.streaming.apply import apply_to_stream, read_entries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _round(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    wanted = set(columns)
    return df.select(*[rounded(c, digits).alias(c) if c in wanted else F.col(c) for c in df.columns])


ID = [GROUP, ENTRY]

# ------------------------------------------------------------ group statistics


@query
def group_zscore(spark, folder):
    df = entries(spark, folder).select(*ID, "l_extendedprice", "qty_n")
    out = groups.group_zscore(df, GROUP, ["l_extendedprice", "qty_n"], heavy=heavy_orders(spark, folder))
    return _round(out, ["l_extendedprice", "qty_n"])


@query
def group_zscore_new(spark, folder):
    df = entries(spark, folder).select(*ID, "price_n", "l_quantity", "is_win")
    out = groups.append_group_zscore(
        df, GROUP, ["price_n", "l_quantity", "is_win"], heavy=heavy_orders(spark, folder)
    )
    return _round(out, ["price_n_norm", "l_quantity_norm"])


@query
def global_zscore(spark, folder):
    df = entries(spark, folder).select(
        *ID, "price_n", "l_quantity", F.lit(3.0).alias("flat"), F.lit(3.0).alias("level")
    )
    out = scaling.standardize(df, ["price_n", "flat"])
    return _round(scaling.normalize(out, ["l_quantity", "level"]), ["price_n", "flat", "l_quantity", "level"])


@query
def mixed_normalize(spark, folder):
    df = entries(spark, folder, orders=True).select(
        *ID, "l_extendedprice", "qty_n", "o_totalprice", "is_win", "flag_n"
    )
    out = groups.mixed_normalize(
        df, GROUP, codes=[ENTRY, "flag_n"], group_level=["o_totalprice"], untouched=["is_win"],
        heavy=heavy_orders(spark, folder),
    )
    return _round(out, ["l_extendedprice", "qty_n", "o_totalprice"])


@query
def group_mean_append(spark, folder):
    df = entries(spark, folder).select(*ID, "price_n", "qty_n")
    out = groups.append_group_means(df, GROUP, ["price_n", "qty_n"], heavy_orders(spark, folder))
    return _round(out, ["price_n_mean", "qty_n_mean"])


@query
def margin_targets(spark, folder):
    df = entries(spark, folder).select(*ID, "time")
    return _round(groups.append_margin(df, GROUP, "time", heavy=heavy_orders(spark, folder)), ["margin"])


@query
def key_zscore_ratio(spark, folder):
    df = entries(spark, folder, parts=True).select(*ID, "distance", "price_n")
    out = keyed.by_key(df, "distance", {"norm": "price_n"}, {"div": "price_n"})
    return _round(out, ["norm", "div"])


@query
def target_set(spark, folder):
    df = entries(spark, folder, parts=True).select(
        *ID, "time", "distance", "odds", "finish", "pay_win", "pay_place"
    )
    out = targets.append_targets(
        df, GROUP, "time", "distance", ENTRY, "odds", "finish", "pay_win", "pay_place",
        heavy=heavy_orders(spark, folder),
    )
    wanted = [
        "win_return", "place_return", "margin", "norm_margin", "div_margin", "norm_time", "div_time",
    ]
    return _round(out.drop("pay_win", "pay_place"), wanted)


@query
def target_set_order(spark, folder):
    df = entries(spark, folder, parts=True).select(
        *ID, "finish", F.nullif(F.col("p_size") % 8, F.lit(5)).alias("base"), "pay_win", "pay_place"
    )
    out = targets.append_order_targets(df, "finish", "base", "pay_win", "pay_place", "pay_place")
    return _round(out.drop("pay_win", "pay_place"), ["win_return", "place_return"])


# --------------------------------------------------------------- slot features


@query
def slot_zscore(spark, folder):
    fields = ["Distance", "Discipline", "FieldStatus", "CourseCode", "TimeDelta", "FinishingTime"]
    df = slots(spark, folder).select("event_id", *[f"pre{i}_{f}" for i in (1, 2, 3) for f in fields])
    out = keyed.append_slot_scores(df)
    scores = [c for c in out.columns if c.endswith("_score")]
    return _round(out.select("event_id", *scores), scores)


@query
def slot_agg3(spark, folder):
    df = slots(spark, folder).select(
        "event_id", *[f"pre{i}_{f}" for i in (1, 2, 3) for f in ("FinishingTime", "Weight", "RaceID")]
    )
    out = features.summarise_slots(df)
    return _round(out, [c for c, t in out.dtypes if t == "double"])


@query
def slot_ratio(spark, folder):
    df = slots(spark, folder).select(
        "event_id",
        *[f"pre{i}_{f}" for i in (1, 2, 3) for f in ("FinishingTime", "Distance", "OrderOfFinish")],
        "pre1_HeadCount", "pre2_HeadCount",
    )
    out = features.append_ratios(df)
    ratios = out.columns[len(df.columns):]
    return _round(out.select("event_id", *ratios), ratios, 8)


@query
def first_corner(spark, folder):
    df = slots(spark, folder).select(
        "event_id", *[f"pre{i}_Pass{j}" for i in (1, 2, 3) for j in (1, 2, 3, 4)]
    )
    out = features.append_corners(df)
    return out.select("event_id", *out.columns[len(df.columns):])


@query
def slot_delta(spark, folder):
    pairs = [
        ("Weight", "pre1_Weight", "weight_delta"),
        ("pre1_Weight", "pre2_Weight", "weight_delta_pre1"),
        ("pre2_Weight", "pre3_Weight", "weight_delta_pre2"),
        ("pre1_OrderOfFinish", "pre1_Pass4", "nobi_pre1"),
        ("pre1_Pass4", "pre1_Pass3", "pass_delta_pre1"),
        ("Distance", "pre1_Distance", "distance_delta"),
    ]
    names = [n for *_, n in pairs]
    return _round(features.append_deltas(slots(spark, folder), pairs).select("event_id", *names), names)


@query
def elapsed_days(spark, folder):
    pairs = [
        ("RegisterdDate", "pre1_RegisterdDate", "elapsed_time"),
        ("pre1_RegisterdDate", "pre2_RegisterdDate", "elapsed_time_1_2"),
        ("pre3_RegisterdDate", "pre2_RegisterdDate", "elapsed_back"),
    ]
    out = features.append_elapsed_days(slots(spark, folder), pairs)
    return out.select("event_id", *[n for *_, n in pairs])


@query
def change_flags(spark, folder):
    pairs = [
        ("pre1_Discipline", "Discipline", "discipline_change"),
        ("pre1_FieldStatus", "FieldStatus", "field_change"),
        ("pre1_CourseCode", "CourseCode", "course_change"),
    ]
    out = features.append_equal_flags(slots(spark, folder), pairs)
    return out.select("event_id", *[n for *_, n in pairs])


@query
def has_flags(spark, folder):
    flags = {f"pre{i}_RaceID": f"has_pre{i}" for i in (1, 2, 3)} | {"RaceID": "has_li"}
    return features.append_missing_flags(slots(spark, folder), flags).select("event_id", *flags.values())


# --------------------------------------------------------- shares and encodings


@query
def code_share(spark, folder):
    style = F.concat(F.col("l_linenumber").cast("string"), F.lit("s"))
    df = entries(spark, folder).select(*ID, style.alias("style"))
    out = groups.append_code_shares(df, GROUP, "style", heavy=heavy_orders(spark, folder))
    return _round(out, out.columns[3:])


@query
def career_rollup(spark, folder):
    out = features.roll_up_career(careers(spark, folder))
    return _round(out, [c for c in out.columns if c.endswith("Per")])


@query
def target_encode(spark, folder):
    df = entries(spark, folder, parts=True).select(*ID, "brand_n", "price_n")
    return _round(encode.target_encode(df, "brand_n", "price_n", k=600, f=300), ["brand_n_te"], 4).drop("price_n")


@query
def target_encode_pairs(spark, folder):
    df = entries(spark, folder, orders=True, parts=True).select(
        *ID, "o_orderpriority", "l_linestatus", "p_type", "flag_n", "is_place", "price_n"
    )
    out = encode.encode_pairs(
        df, ["o_orderpriority", "l_linestatus", "absent"], ["p_type", "flag_n"], ["is_place", "price_n"]
    )
    wanted = out.columns[len(df.columns):]
    return _round(out.select(*ID, *wanted), wanted, 4)


@query
def target_encode_many(spark, folder):
    """Five group codes by eight entry codes, two targets each."""
    more = {
        "y": F.col("year"), "m": F.col("month"), "size": F.col("p_size"), "line": F.col("l_linenumber"),
        "supplier": F.col("l_suppkey"), "begin": F.substring("p_name", 1, 3),
    }
    df = entries(spark, folder, orders=True, parts=True).select(
        *ID, "is_place", "price_n", "o_orderpriority", "l_linestatus", "flag_n", "p_type", "l_returnflag", "brand_n", "p_name",
        *[c.cast("string").alias(n) for n, c in more.items()],
    )
    df = stored(df, "pairs")  # read by the fit and by the lookups
    return encode.encode_pairs(
        df, ["o_orderpriority", "l_linestatus", "flag_n", "y", "m"],
        ["p_type", "l_returnflag", "brand_n", "p_name", "size", "line", "supplier", "begin"], ["is_place", "price_n"],
        keep=ID, finish=lambda value: rounded(value, 4),
    )


CODES = ["l_returnflag", "flag_n", "p_type", "brand_n", "p_name"]


@query
def value_counts(spark, folder):
    return encode.value_counts(entries(spark, folder, parts=True), CODES)


@query
def distinct_counts(spark, folder):
    return encode.distinct_counts(entries(spark, folder, parts=True), CODES)


@query
def fold_rare_others(spark, folder):
    df = entries(spark, folder, parts=True).select(*ID, "p_name", "flag_n", "brand_n")
    return encode.fold_others(df, ["p_name", "flag_n", "brand_n"], GROUP, keep_above=940)


@query
def fold_rare_few(spark, folder):
    mix = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    df = entries(spark, folder, parts=True).select(*ID, mix.alias("mix"), "flag_n")
    return encode.fold_few(df, ["mix", "flag_n"], GROUP, below=45)


@query
def label_encode(spark, folder):
    df = entries(spark, folder, parts=True).select(*ID, "p_name", "flag_n", "brand_n")
    return encode.label_encode(df, ["p_name", "flag_n", "brand_n"])


@query
def one_hot(spark, folder):
    df = entries(spark, folder).select(*ID, "flag_n", "l_linestatus")
    return encode.one_hot(df, ["flag_n", "l_linestatus"])


def _max_codes(spark, folder):
    df = stored(entries(spark, folder, orders=True, parts=True).select("p_brand", "p_name", "flag_n", "year"), "codes")
    codes = ["p_brand", "p_name", "flag_n"]
    before, after = splits.split_by_year(encode.label_encode(df, codes), 2000, "year")
    return encode.max_codes([before, after], codes)


@query
def max_code(spark, folder):
    return _max_codes(spark, folder)


@query
def embedding_width(spark, folder):
    sizes = _max_codes(spark, folder)
    return sizes.select(
        "column",
        *[
            fc.embedding_width(F.col("max_code") + 1, s).alias(s)
            for s in ("divided", "capped_10", "capped_5")
        ],
    )


# ------------------------------------------------------------------ null handling

NULLABLE = ["price_n", "qty_n", "flag_n", "pay_win", "pred"]


@query
def null_count(spark, folder):
    return nulls.null_count(entries(spark, folder).select(*ID, *NULLABLE)).select(*ID, "null_count")


@query
def completeness(spark, folder):
    return _round(nulls.completeness(entries(spark, folder).select(*ID, *NULLABLE)), ["completeness"])


@query
def fill_global(spark, folder):
    df = entries(spark, folder).select(
        *ID, "price_n", "qty_n", F.lit(None).cast("double").alias("empty"), "flag_n"
    )
    out = nulls.fill_global(df, ["price_n", "qty_n", "empty"], ["flag_n"])
    return _round(out, ["price_n", "qty_n", "empty"], 4)


@query
def fill_group(spark, folder):
    df = entries(spark, folder).select(*ID, "price_n", "qty_n", "pay_win", "flag_n")
    numbers = ["price_n", "qty_n", "pay_win"]
    out = nulls.fill_group(df, GROUP, numbers, ["flag_n"], heavy=heavy_orders(spark, folder))
    return _round(out, numbers)


@query
def fill_zero(spark, folder):
    return nulls.fill_zero(entries(spark, folder).select(*ID, "price_n", "qty_n"), ["price_n", "qty_n"])


@query
def payback_scale(spark, folder):
    df = entries(spark, folder).select(*ID, "pay_win", "pay_place")
    out = nulls.scale_paybacks(df, ["pay_win", "pay_place"])
    return _round(out, ["pay_win", "pay_place", "pay_win_eval", "pay_place_eval"])


@query
def column_profile(spark, folder):
    numbers = ["l_quantity", "price_n", "qty_n", "pay_win"]
    return _round(nulls.column_profile(entries(spark, folder), numbers, ["flag_n"]), ["mean", "std"], 4)


@query
def merged_profile(spark, folder):
    """Profiles kept by year and merged; an estimate above 200 values is held to 4 % of the exact count."""
    columns = ["l_quantity", "price_n", "flag_n", "p_name", "brand_n", "l_orderkey"]
    rows = stored(entries(spark, folder, orders=True, parts=True).select("year", *columns), "profiled")
    merged = profiles.merge_profiles(stored(profiles.sketch_columns(rows, columns, by=["year"]), "profiles"))
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in columns])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in columns])))
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= F.when(F.col("exact") <= 200, 0).otherwise(0.04 * F.col("exact"))
    return merged.join(exact, "column").select(
        "column", "rows", "nulls", near.alias("near"), rounded("largest", 2).alias("largest"), "largest_text",
        rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"),
    )


# -------------------------------------------------------------------- projections


@query
def distance_bucket(spark, folder):
    df = entries(spark, folder, parts=True)
    length = F.col("distance") * 60
    return df.select(*ID, length.alias("length"), fc.distance_bucket(length).alias("distance_category"))


@query
def code_lookup(spark, folder):
    code = F.concat(F.lpad((F.col("p_size") % 27).cast("string"), 2, "0"), F.lit("s"))
    df = entries(spark, folder, parts=True).select(
        *ID, (F.col("p_size") * 60).alias("length"), F.nullif(code, F.lit("03s")).alias("hoof")
    )
    return features.append_classes(df, "length", "hoof")


@query
def choose_by_code(spark, folder):
    df = entries(spark, folder)
    chosen = fc.choose_by_code(
        F.col("flag_n"), {"A": F.col("l_extendedprice"), "N": F.col("l_quantity")}
    )
    return df.select(*ID, chosen.alias("chosen"))


@query
def combine_codes(spark, folder):
    blanked = F.when(F.col("p_type") == "SMALL", F.lit("s")).otherwise(F.col("p_type"))
    df = entries(spark, folder, orders=True, parts=True).select(
        *ID, "flag_n", blanked.alias("hi_Kind"), "l_linestatus", F.col("o_orderstatus").alias("ri_Status")
    )
    out = features.append_combined_codes(df, ["flag_n", "hi_Kind"], ["ri_Status", "l_linestatus"])
    return out.select(*ID, *out.columns[len(df.columns):])


@query
def season_cycle(spark, folder):
    df = entries(spark, folder, orders=True).select(*ID, "month")
    return _round(features.append_season(df, "month"), ["season_sin", "season_cos"])


@query
def log_target(spark, folder):
    df = entries(spark, folder).select(*ID, "odds", "price_n")
    names = {"odds": "log_odds", "price_n": "log_price"}
    return _round(features.append_log_deltas(df, names).select(*ID, *names.values()), list(names.values()))


@query
def row_filters(spark, folder):
    df = entries(spark, folder, orders=True, parts=True).select(
        *ID, "qty_n", "odds", "flag_n", "year", "p_size", "l_returnflag", "finish"
    )
    df = filters.with_label(df, ["qty_n", "odds"], nonzero=["odds"])
    df = filters.without_codes(df, "flag_n", ["A"])
    df = df.withColumn("bucket", fc.distance_bucket(F.col("p_size") * 60))
    df = filters.only_code(df, "bucket", "middle")
    df = filters.only_years(filters.from_year(df, 1997, "year"), range(1996, 2001), "year")
    return df.select(
        *ID, "year", fc.recode(F.col("flag_n"), "N", "s").alias("flag"),
        fc.value_flag(F.col("finish"), 1).alias("first"),
    )


# ----------------------------------------------------------------------- ranking


@query
def popularity_order(spark, folder):
    df = entries(spark, folder).select(*ID, "odds")
    return ranks.append_popularity(df, GROUP, "odds", ENTRY, heavy=heavy_orders(spark, folder))


@query
def pred_rank(spark, folder):
    df = entries(spark, folder).select(*ID, "pred")
    return ranks.append_pred_order(df, GROUP, heavy=heavy_orders(spark, folder))


@query
def group_chain(spark, folder):
    """Five group operators on a table that is searched for heavy groups and split once."""
    df = entries(spark, folder).select("l_suppkey", ENTRY, "time", "odds", "pred", "l_quantity")
    cut = split(df, "l_suppkey")
    cut = groups.append_margin(cut, "l_suppkey", "time")
    cut = ranks.append_popularity(cut, "l_suppkey", "odds", ENTRY)
    cut = ranks.append_pred_order(cut, "l_suppkey")
    cut = ranks.append_pick(cut, "l_suppkey", "pred", ENTRY, "argmax")
    cut = groups.leave_one_out(cut, "l_suppkey", {"rest": "l_quantity"})
    out = cut.merged().select(
        "l_suppkey", ENTRY, "margin", "pops_order", "pred_order", "pred_bin", "rest", "others"
    )
    return _round(out, ["margin", "rest"])


@query
def draw_many_groups(spark, folder):
    """100,000 draws of two groups: entries and the least and greatest entry of each draw."""
    df = entries(spark, folder).select(*ID)
    drawn = reshape.draw_groups(df, GROUP, draws=100_000, per_draw=2, seed=10)
    return drawn.groupBy("draw").agg(
        F.count(F.lit(1)).alias("entries"), F.min(ENTRY).alias("least"), F.max(ENTRY).alias("greatest")
    )


@query
def top1_pick(spark, folder):
    df = entries(spark, folder).select(*ID, "pred")
    heavy = heavy_orders(spark, folder)
    df = ranks.append_pick(df, GROUP, "pred", ENTRY, "argmax", "pick_max", heavy)
    return ranks.append_pick(df, GROUP, "pred", ENTRY, "argmin", "pick_min", heavy)


@query
def crowd_flag(spark, folder):
    df = entries(spark, folder).select(*ID, "odds", "pred", "finish", "is_place")
    heavy = heavy_orders(spark, folder)
    df = ranks.append_popularity(df, GROUP, "odds", ENTRY, heavy=heavy)
    df = ranks.append_pred_order(df, GROUP, heavy=heavy)
    df = ranks.append_value_flag(targets.append_crowd_flags(df, "finish"))
    return df.select(*ID, "oof_over_pops", "pop_prediction", "kaime")


@query
def leave_one_out(spark, folder):
    df = entries(spark, folder).select(*ID, "price_n")
    out = groups.leave_one_out(
        df, GROUP, {"price_others": "price_n"}, "others", heavy_orders(spark, folder)
    )
    return _round(out.drop("price_n"), ["price_others"], 3)


# ----------------------------------------------------------------- group filters


@query
def drop_groups_no_winner(spark, folder):
    df = entries(spark, folder).select(*ID, "is_win")
    return groups.drop_groups_without(df, GROUP, "is_win", heavy_orders(spark, folder))


@query
def drop_groups_zero_sum(spark, folder):
    df = entries(spark, folder).select(*ID, "pay_win")
    out = groups.drop_groups_zero_sum(df, GROUP, "pay_win", heavy_orders(spark, folder))
    return _round(out, ["pay_win"])


@query
def keep_groups(spark, folder):
    orders = table(spark, folder, "orders").filter("o_orderstatus = 'P'")
    orders = orders.select(F.col("o_orderkey").alias(GROUP))
    df = entries(spark, folder).select(*ID, "l_quantity")
    return groups.keep_groups(df, orders, GROUP)


@query
def drop_listed_groups(spark, folder):
    orders = table(spark, folder, "orders").filter("o_orderstatus = 'P'")
    orders = orders.select(F.col("o_orderkey").alias(GROUP))
    df = entries(spark, folder).select(*ID, "l_quantity")
    return groups.drop_listed_groups(df, orders, GROUP)


# ------------------------------------------------------------------------ splits


@query
def year_split(spark, folder):
    df = entries(spark, folder, orders=True).select(*ID, "year")
    before, after = splits.split_by_year(df, 2000, "year")
    return before.withColumn("split", F.lit("train")).unionByName(after.withColumn("split", F.lit("test")))


@query
def group_kfold(spark, folder):
    return splits.append_group_fold(entries(spark, folder).select(*ID), GROUP, 10)


@query
def row_kfold(spark, folder):
    return splits.append_row_fold(entries(spark, folder).select(*ID), ENTRY, 3)


@query
def holdout_groups(spark, folder):
    df = filters.from_year(entries(spark, folder, orders=True).select(*ID, "year"), 1997, "year")
    return splits.hold_out_groups(df, GROUP)


@query
def downsample_exact(spark, folder):
    return splits.downsample(entries(spark, folder).select(*ID, "is_win"), "is_win", ENTRY)


@query
def upsample_exact(spark, folder):
    return splits.upsample(entries(spark, folder).select(*ID, "is_win"), "is_win", ENTRY)


@query
def row_split(spark, folder):
    train, test = splits.random_split(entries(spark, folder).select(*ID), ENTRY, 0.1, 32)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query
def action_sample(spark, folder):
    df = entries(spark, folder)
    return df.select(
        *ID,
        splits.draw_action(F.col("score"), ENTRY, 7).alias("drawn"),
        splits.flip_action((F.col("score") > 0.5).cast("int"), ENTRY, 0.05, 8).alias("flipped"),
    )


# ------------------------------------------------------------------- group arrays


def _blocks(spark, folder):
    df = entries(spark, folder).select(
        *ID, "l_extendedprice", "score", "l_linenumber", "finish", "is_win", "is_place"
    )
    return reshape.group_blocks(
        df, GROUP, ENTRY, ["l_extendedprice", "score"], ["l_linenumber"],
        {"finish": 19, "is_win": 0, "is_place": 0}, seed=5, heavy=heavy_orders(spark, folder),
    )


def _in_cents(spark, folder):
    """Entries with prices in whole cents, whose sums do not depend on the order of the terms."""
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("double").alias("l_extendedprice")
    return entries(spark, folder).select("l_suppkey", ENTRY, cents, "score", "l_linenumber", "is_win")


def _wide_blocks(spark, folder):
    """Groups of hundreds of entries."""
    df = _in_cents(spark, folder)
    return reshape.group_blocks(
        df, "l_suppkey", ENTRY, ["l_extendedprice", "score"], ["l_linenumber"], {"is_win": 0}, seed=5
    )


def _as_text(values: Column) -> Column:
    """Array as text in millionths."""
    return F.array_join(F.transform(values, lambda v: F.floor(v * 1000000 + 0.5)), ",")


@query
def pad_groups(spark, folder):
    rows = _blocks(spark, folder).select(GROUP, "block", F.inline("rows"))
    return _round(rows, ["l_extendedprice", "score"])


@query
def pad_shuffled_groups(spark, folder):
    df = _in_cents(spark, folder)
    out = reshape.pad_groups(
        df, "l_suppkey", ENTRY, ["l_extendedprice", "score"], ["l_linenumber"], {"is_win": 0}, seed=5
    )
    return _round(out, ["l_extendedprice", "score"])


@query
def pad_wide_groups(spark, folder):
    df = _in_cents(spark, folder)
    out = reshape.pad_wide_groups(
        df, "l_suppkey", ENTRY, ["l_extendedprice", "score"], ["l_linenumber"], {"is_win": 0}, seed=5
    )
    return _round(out, ["l_extendedprice", "score"])


@query
def group_tensor(spark, folder):
    return _tensor_text(_blocks(spark, folder), GROUP)


@query
def group_tensor_wide(spark, folder):
    return _tensor_text(_wide_blocks(spark, folder), "l_suppkey")


def _tensor_text(blocks, group):
    out = reshape.block_tensors(blocks, group, ["l_extendedprice", "score"], ["l_linenumber"], ["is_win"])
    return out.select(
        group,
        "block",
        F.size("main").alias("width"),
        _as_text(F.flatten("main")).alias("main"),
        F.array_join("l_linenumber", ",").alias("line"),
        F.array_join("is_win", ",").alias("win"),
    )


@query
def group_rows(spark, folder):
    df = entries(spark, folder).select(*ID, "l_extendedprice", "l_quantity", "score")
    out = reshape.group_rows(
        df, GROUP, ENTRY, ["l_extendedprice", "l_quantity"], "score", 4, heavy_orders(spark, folder)
    )
    return out.select(
        GROUP, "chunk", F.size("y").alias("entries"),
        _as_text(F.flatten("x")).alias("x"), _as_text(F.col("y")).alias("y"),
    )


@query
def draw_groups(spark, folder):
    df = entries(spark, folder).select(*ID)
    return reshape.draw_groups(df, GROUP, draws=64, per_draw=2, seed=9)


# ------------------------------------------------------------------------ reports


def _scored(spark, folder):
    return entries(spark, folder).select(*ID, "pred", "odds", "is_win", "is_place", "pay_win", "pay_place")


@query
def top1_report(spark, folder):
    df = _scored(spark, folder)
    best = evaluate.top1_report(df, GROUP, ENTRY, "pred", "argmax", "pay_win", "pay_place")
    least = evaluate.top1_report(df, GROUP, ENTRY, "pred", "argmin", "pay_win", "pay_place")
    out = best.withColumn("mode", F.lit("argmax")).unionByName(least.withColumn("mode", F.lit("argmin")))
    return _round(out, ["win_hit", "win_return", "place_hit", "place_return"])


@query
def value_bet_report(spark, folder):
    heavy = heavy_orders(spark, folder)
    df = ranks.append_popularity(_scored(spark, folder), GROUP, "odds", ENTRY, heavy=heavy)
    df = ranks.append_value_flag(ranks.append_pred_order(df, GROUP, heavy=heavy))
    out = evaluate.value_bet_report(df, GROUP, ENTRY, "pred", "argmin", "pay_win", "pay_place")
    return _round(out, ["win_hit", "win_return", "place_hit", "place_return"])


@query
def fold_summary(spark, folder):
    df = splits.append_group_fold(_scored(spark, folder), GROUP, 5)
    picks = ranks.best_of_group(
        df, GROUP, "pred", ENTRY, "argmin", ["fold", "is_win", "is_place", "pay_win", "pay_place"]
    )
    scores = picks.groupBy("fold").agg(
        F.avg("is_win").alias("win_hit"),
        F.avg("is_place").alias("place_hit"),
        (F.avg(F.coalesce("pay_win", F.lit(0.0))) / 100).alias("win_return"),
        (F.avg(F.coalesce("pay_place", F.lit(0.0))) / 100).alias("place_return"),
    )
    out = evaluate.fold_summary(scores, models.METRICS)
    return _round(out, out.columns)


@query
def threshold_sweep(spark, folder):
    out = evaluate.threshold_sweep(_scored(spark, folder), "pred", "pay_win", "pay_place")
    return _round(out, [c for c in out.columns if c != "buys"])


@query
def buy_skip_report(spark, folder):
    df = entries(spark, folder).select(
        F.col("pred").alias("p_buy"), (1 - F.col("pred")).alias("p_skip"), (F.col("l_discount") * 20).alias("y")
    )
    return _round(evaluate.buy_skip_report(df), ["hit_ratio", "return_ratio"])


@query
def argmax_hit(spark, folder):
    df = entries(spark, folder).select(*ID, "pred", "finish")
    return _round(evaluate.argmax_hit(df, GROUP, ENTRY, "pred", "finish"), ["hit_ratio"])


@query
def winner_accuracy(spark, folder):
    df = entries(spark, folder).select(*ID, "pred", "time")
    df = groups.append_margin(df, GROUP, "time", heavy=heavy_orders(spark, folder))
    return _round(evaluate.winner_accuracy(df, GROUP, ENTRY, "pred"), ["accuracy"])


def _pairwise_input(spark, folder, group=GROUP, heavy=None):
    df = entries(spark, folder).select(group, ENTRY, "score", F.col("l_discount").alias("gap"))
    blocks = reshape.group_blocks(df, group, ENTRY, ["score", "gap"], seed=5, heavy=heavy)
    return reshape.block_tensors(blocks, group, ["score"], labels=["score", "gap"])


def _pairwise(loss, spark, folder, group=GROUP):
    heavy = heavy_orders(spark, folder) if group == GROUP else None
    return _round(loss(_pairwise_input(spark, folder, group, heavy), group, "score", "gap"), ["loss"])


@query
def pairwise_xent(spark, folder):
    return _pairwise(evaluate.pairwise_cross_entropy, spark, folder)


@query
def pairwise_softplus(spark, folder):
    return _pairwise(evaluate.pairwise_softplus, spark, folder)


@query
def pairwise_xent_wide(spark, folder):
    return _pairwise(evaluate.pairwise_cross_entropy, spark, folder, "l_suppkey")


@query
def pairwise_softplus_wide(spark, folder):
    return _pairwise(evaluate.pairwise_softplus, spark, folder, "l_suppkey")


@query
def cross_entropy(spark, folder):
    df = entries(spark, folder).select("score", "is_win")
    return _round(evaluate.cross_entropy(df, "is_win", "score"), ["cross_entropy", "log_loss"])


@query
def loo_reward(spark, folder):
    df = entries(spark, folder).select(
        *ID, (F.col("l_discount") * 20 + 0.013).alias("y"), (F.col("score") > 0.5).cast("int").alias("buy")
    )
    out = evaluate.append_rewards(df, GROUP, heavy=heavy_orders(spark, folder))
    return _round(out.drop("y"), ["reward_skip", "reward_buy"])


# ------------------------------------------------------------------- model jobs

MODEL_FEATURES = ["l_quantity", "l_extendedprice", "l_tax", "l_linenumber"]


def _model_rows(spark, folder):
    df = entries(spark, folder, orders=True).select(
        *ID, *MODEL_FEATURES, "year", "is_win", "is_place", "l_discount",
        F.col("pay_win").alias("hr_PaybackWin"), F.col("pay_place").alias("hr_PaybackPlace"),
    )
    return stored(df.withColumn("label", F.col("l_quantity") / 50 + F.col("l_discount")), "model_rows")


@query
def gbt_fit_score(spark, folder):
    train, test = splits.split_by_year(_model_rows(spark, folder), 2000, "year")
    job = models.Boosting(MODEL_FEATURES, "label", params={"maxIter": 5})
    scored = models.score(models.fit_boosting(train, job), test)
    return _round(scored.select(*ID, "label", "pred"), ["label", "pred"])


@query
def gbt_cv(spark, folder):
    df = splits.append_group_fold(_model_rows(spark, folder), GROUP, 5)
    job = models.Boosting(MODEL_FEATURES, "label", params={"maxIter": 2})
    return models.cross_validate(df, job, 5, grid={"maxDepth": [2, 3], "minInstancesPerNode": [1, 20, 85]})


@query
def gbt_search(spark, folder):
    """Parameter sets drawn at random, best first: the rows do not depend on the numbers of the trees."""
    df = splits.append_group_fold(_model_rows(spark, folder), GROUP, 5)
    job = models.Boosting(MODEL_FEATURES, "label", params={"maxIter": 2})
    space = {"maxDepth": [2, 3], "subsamplingRate": [0.61, 1.0], "featureSubsetStrategy": ["all", "0.5"]}
    found = models.search(df, job, models.random_trials(space, 6), 5)
    order = Window.orderBy(F.monotonically_increasing_id())  # six rows
    sorted_ = F.coalesce(F.col("metric") >= F.lag("metric").over(order), F.lit(True))
    return found.withColumn("in_order", sorted_).select("trial", "in_order", (F.col("metric") > 0).alias("measured"))


@query
def gbt_nominal(spark, folder):
    """One split of a nominal column by a set of its values explains the label, which no split in text order could; a number
    that is missing where the label is 2 is told by its flag."""
    df = entries(spark, folder, parts=True).select("p_brand", "l_quantity", "l_linenumber")
    odd = F.substring("p_brand", -1, 1).cast("int") % 2
    df = df.withColumn("label", odd.cast("double")).withColumn("constant", F.lit(1.0))
    job = models.Boosting(["constant"], "label", params={"maxIter": 1, "maxDepth": 1}, codes=["p_brand"])
    sets = models.score(models.fit_boosting(df, job), df)
    gaps = df.withColumn("label", F.when(F.col("l_linenumber") == 2, 2.0).otherwise(0.0)).withColumn(
        "seen", F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))
    )
    job = models.Boosting(["seen"], "label", params={"maxIter": 1, "maxDepth": 1})
    flags = models.score(models.fit_boosting(gaps, job), gaps)
    report = lambda df, kind: df.agg(
        F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"),
        (F.max(F.abs(F.col("label") - F.col("pred"))) < 1e-9).alias("exact"),
        (F.avg((F.col("label") - F.col("pred")) ** 2) < F.var_pop("label")).alias("beats_constant"),
    )
    return report(sets, "set").unionByName(report(flags, "flag"))


@query
def gbt_folds(spark, folder):
    df = splits.append_group_fold(_model_rows(spark, folder), GROUP, 5)
    job = models.Boosting(MODEL_FEATURES, "label", params=models.UNTIL_WORSE)
    scores, _ = models.fit_folds(df, job, 5, GROUP, ENTRY, parallelism=5)
    return scores


@query
def feature_importance(spark, folder):
    train, _ = splits.split_by_year(_model_rows(spark, folder), 2000, "year")
    job = models.Boosting(MODEL_FEATURES, "is_win", "binary", {"maxIter": 3})
    table = models.feature_importance(models.fit_boosting(train, job), MODEL_FEATURES)
    return ranks.by_importance(table)


@query
def ablation(spark, folder):
    train, test = splits.split_by_year(_model_rows(spark, folder), 2000, "year")
    job = models.Boosting(MODEL_FEATURES, "label", params={"maxIter": 2})
    return models.ablation(train, test, job)


# ------------------------------------------------------------- columns and model input


@query
def feature_columns(spark, folder):
    """Columns that no process feature guards, with the label; the process features go by name elsewhere."""
    df = entries(spark, folder).select(*ID, "is_win", "is_place", "score", "l_tax", F.col("odds").alias("li_WinOdds"))
    features = columns.features_and_label(df, "is_win")
    return features.select(*columns.present_columns(features, ["label", "score", "l_tax", GROUP, ENTRY, "absent"]))


@query
def chosen_columns(spark, folder):
    df = entries(spark, folder).select(*ID, "is_win", "score", "l_tax", "l_discount", "l_quantity", F.lit(1).alias("has_pre1"))
    df = columns.drop_or_keep(df, remove=["l_tax"])
    df = columns.choose_columns(df, remove=["l_discount"])
    df = columns.choose_columns(df, keep=["l_quantity", *ID], process_features=["is_win", "score"])
    df = columns.drop_process_features(columns.drop_listed(df, ["absent"]))
    return columns.numbers_codes_others(columns.sort_columns(df), [ENTRY], ["l_quantity"])


@query
def cast_codes(spark, folder):
    df = entries(spark, folder).select(
        *ID, F.col("l_linenumber").cast("long").alias("line"), F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax")).alias("tax"), "l_quantity",
    )
    codes, numbers = columns.codes_and_numbers(df, ["line", GROUP])
    df = columns.shrink_codes(columns.nan_to_null(df), [c for c in codes if c != ENTRY])
    return columns.to_float(df, [n for n in numbers if n != "tax"])


@query
def model_input(spark, folder):
    df = entries(spark, folder).select(*ID, "l_quantity", "l_tax", "flag_n", "l_linestatus")
    out = encode.model_input(df, ["l_tax", "l_quantity"], ["l_linestatus", "flag_n"], ID)
    return out.withColumn("main", _as_text(F.col("main")))


@query
def one_hot_wide(spark, folder):
    """Codes of few values as columns and of many as vectors: the place of the value, in text order, and the sum."""
    df = entries(spark, folder, parts=True).select(*ID, "flag_n", "p_name")
    out = encode.one_hot(df, ["flag_n", "p_name"], max_columns=10)
    values = vector_to_array("p_name_vector")
    return out.select(
        *ID, "flag_n_A", "flag_n_N", (F.array_position(values, 1.0) - 1).cast("int").alias("place"),
        F.aggregate(values, F.lit(0.0), lambda a, b: a + b).alias("total"),
    )


@query
def shuffled_sample(spark, folder):
    """The first 1,000 entries of a repeatable random order."""
    return ranks.shuffled(entries(spark, folder).select(*ID, "l_quantity"), ENTRY, 3).limit(1000)


@query
def importance_order(spark, folder):
    """Statuses by how often they occur, from small to large."""
    table_ = entries(spark, folder).groupBy(F.concat("l_returnflag", "l_linestatus").alias("feature")).agg(
        F.count(F.lit(1)).cast("double").alias("importance")
    )
    order = Window.orderBy(F.monotonically_increasing_id())  # a few rows
    return ranks.by_importance(table_).withColumn("place", F.row_number().over(order))


# ---------------------------------------------------------------- sources and sinks


@query
def declared_scan(spark, folder):
    """A CSV scan by a declared-schema file, which keeps result columns out, an exclude list and an include list."""
    path = shared_folder(spark, "declared")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", rounded("o_totalprice", 2).alias("o_totalprice"), F.col("o_custkey").alias("hr_Secret")
    )
    orders.write.csv(f"{path}/rows", header=True)
    kinds = {"bigint": "int64", "double": "float64", "string": "object"}
    for name, lines in {
        "types": [f"{n},{kinds[k]}" for n, k in orders.dtypes], "remove": ["# not used", "", "o_orderstatus"], "keep": ["o_totalprice", "o_orderkey"],
    }.items():
        spark.createDataFrame([(line,) for line in lines], "line string").coalesce(1).write.text(f"{path}/{name}")
    declared = schema.load_schema(spark, f"{path}/types")
    df = columns.drop_or_keep(files.read_csv(spark, f"{path}/rows", declared), remove=schema.load_removes(spark, f"{path}/remove"))
    return columns.drop_or_keep(df, keep=schema.load_keeps(spark, f"{path}/keep"))


@query
def held_out_sample(spark, folder):
    """Held-out rows written as CSV and read again, whole and limited."""
    path = shared_folder(spark, "sample")
    rows = entries(spark, folder).select(*ID, "l_quantity")
    _, test = splits.random_split(rows, ENTRY, 0.1, 32)
    files.write_sample(test, path)
    kind = T.StructType.fromDDL("l_orderkey long, entry_id string, l_quantity double")
    whole = files.read_csv(spark, path, kind).agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))
    part = files.read_csv(spark, path, kind, rows=100).agg(F.count(F.lit(1)).alias("limited"))
    return whole.withColumn("limited", F.lit(part.first()[0]).cast("long"))


def _csv_layouts(spark, folder):
    """The orders as CSV files of two layouts, with markers of missing values and numbers that are none."""
    path = shared_folder(spark, "csv")
    order = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        order.cast("string").alias("o_orderkey"),
        F.when(order % 7 == 0, "NA").when(order % 11 == 0, " nan").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(order % 13 == 0, "12,5 EUR").when(order % 17 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(order % 19 == 0, F.concat((order % 5).cast("string"), F.lit(".0"))).otherwise((order % 5).cast("string")).alias("lines"),
    )
    rows.filter(order % 2 == 0).write.csv(f"{path}/a", header=True)
    other = rows.filter(order % 2 == 1).select("o_totalprice", F.lit("x").alias("more"), "lines", "o_orderstatus", "o_orderkey")
    other.write.csv(f"{path}/b", header=True)
    kind = T.StructType.fromDDL("o_orderkey long, o_orderstatus string, o_totalprice double, lines int")
    return [f"{path}/a", f"{path}/b"], kind


@query
def csv_scan(spark, folder):
    path, kind = _csv_layouts(spark, folder)
    return files.read_csv(spark, path, kind, bad="null")


@query
def csv_bad_values(spark, folder):
    path, kind = _csv_layouts(spark, folder)
    found = files.bad_values(spark, path, kind)
    return found.select("column", "value", F.get_json_object("record", "$.o_orderkey").cast("long").alias("o_orderkey"))


@query
def csv_to_parquet(spark, folder):
    """CSV to a table with a folder per status, read again without the index column of the writer."""
    path, run = shared_folder(spark, "csv"), shared_folder(spark, "table")
    source = table(spark, folder, "orders").select(
        F.monotonically_increasing_id().alias("index"), "o_orderkey", "o_orderstatus", rounded("o_totalprice", 2).alias("o_totalprice")
    )
    source.write.csv(path, header=True)
    kind = T.StructType.fromDDL("index long, o_orderkey long, o_orderstatus string, o_totalprice double")
    files.convert_csv(spark, path, run, kind, ("o_orderstatus",))
    return files.read_table(spark, run)


@query
def scored_table(spark, folder):
    """Training and test rows in one table with a folder per split."""
    rows = entries(spark, folder, orders=True).select(*ID, "year", "pred")
    train, test = splits.split_by_year(rows, 2000, "year")
    run = shared_folder(spark, "scored")
    files.write_scored(train, test, run)
    return files.read_table(spark, run)


# --------------------------------------------------------------------- streaming


@query
def stream_apply(spark, folder):
    events = table(spark, folder, "events")
    stage = fitted.target_means("event_type", "value", "value_te", k=1000, f=500).fit(events)
    stream = read_entries(spark, f"{folder}/events*.parquet", events.schema)
    run = shared_folder(spark, "stream_apply")
    apply_to_stream(stream, stage, f"{run}/out", f"{run}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{run}/out").select("event_id", "event_type", "value_te")
    return _round(out, ["value_te"])
