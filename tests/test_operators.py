"""Edge cases and properties on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from groupstats.functions import columns as fc
from groupstats.operators import columns, encode, evaluate, features, groups, keyed, nulls, ranks, reshape, scaling, splits
from groupstats.skew import find_heavy, hash_cuts, hash_of, number_rows, with_stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, order, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [
        ("a", 1, 10.0, 0.5), ("a", 2, 0.0, None), ("a", 3, 14.0, 3.0), ("a", 4, None, 3.0),
        ("b", 5, 8.0, 2.0), (None, 6, 7.0, 5.0), (None, 7, 9.0, 4.0),
    ]
    return frame(spark, rows, "g string, id int, time double, odds double").cache()


def test_lone_entry_has_no_zscore_and_equal_values_score_zero(spark):
    df = frame(spark, [("a", 1, 5.0), ("a", 2, 5.0), ("b", 3, 1.0)], "g string, id int, x double")
    assert values(groups.group_zscore(df, "g", ["x"]), "id", "x") == [(0.0,), (0.0,), (None,)]


def test_group_zscore_has_mean_zero_and_deviation_one(spark):
    df = spark.range(200).select((F.col("id") % 10).alias("g"), (F.rand(3) * 9).alias("x"))
    out = groups.group_zscore(df, "g", ["x"]).groupBy("g").agg(F.avg("x").alias("m"), F.stddev("x").alias("s"))
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in out.collect())


def test_margin_ignores_zero_times_and_groupless_rows(tiny):
    assert values(groups.append_margin(tiny, "g", "time"), "id", "id", "margin") == [
        (1, 0.0), (2, None), (3, 4.0), (4, None), (5, 0.0),
    ]


def test_popularity_breaks_ties_by_entry_and_replaces_bad_odds(tiny):
    out = ranks.append_popularity(tiny.filter("g = 'a'"), "g", "odds", "id")
    assert values(out, "id", "odds", "pops_order") == [(99.0, 3), (99.0, 4), (3.0, 1), (3.0, 2)]


def test_pred_order_leaves_missing_unranked(spark):
    df = frame(spark, [("a", 1, 0.5), ("a", 2, None), ("a", 3, 0.5), ("a", 4, 0.9)], "g string, id int, pred double")
    assert values(ranks.append_pred_order(df, "g"), "id", "pred_order") == [(1,), (None,), (1,), (3,)]


def test_key_statistics_drop_missing_keys_and_avoid_division_by_zero(spark):
    df = frame(spark, [(1, 2.0), (1, 2.0), (2, 5.0), (None, 1.0)], "k int, x double")
    out = keyed.by_key(df, "k", {"z": "x"}, {"r": "x"})
    assert sorted(map(tuple, out.select("k", "z", "r").collect())) == [(1, None, 1.0), (1, None, 1.0), (2, None, 1.0)]


def test_heavy_and_plain_paths_agree(spark, heavy_everything):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("g"),
        "id", ((F.col("id") * 7919) % 101).cast("double").alias("x"),
    ).cache()
    heavy = find_heavy(df, "g")
    # residues 0..49, the common key and NULL all have more than one row
    assert heavy.rows.count() == 52 and heavy.rows.filter("g IS NULL").count() == 1
    order = [F.col("x").asc(), F.col("id").asc()]
    split = number_rows(df, "g", order, "n", heavy)
    split = with_stats(split, "g", {"m": F.avg("x"), "s": F.stddev_samp("x")}, heavy)
    pdf = df.toPandas().sort_values(["x", "id"])
    pdf["n"] = pdf.groupby("g", dropna=False).cumcount() + 1
    pdf["m"] = pdf.groupby("g").x.transform("mean")
    got = split.toPandas().set_index("id").sort_index()
    want = pdf.set_index("id").sort_index()
    assert (got.n == want.n).all()
    assert (got.m - want.m).abs().max() < 1e-9 and got.m.isna().sum() == want.m.isna().sum()


def test_hash_cuts_are_the_sorted_digests(spark):
    ids = spark.range(500)
    digests = sorted(r[0] for r in ids.select(hash_of(["id"], 3)).collect())
    assert hash_cuts(ids, ["id"], 3, [1, 250, 500, 501, 0]) == [digests[0], digests[249], digests[499], "g", ""]


def test_group_folds_are_disjoint_complete_and_even(spark):
    df = spark.range(300).select((F.col("id") % 103).alias("g"), "id")
    out = splits.append_group_fold(df, "g", 10)
    per_group = out.groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0]
    sizes = {r["fold"]: r["n"] for r in out.groupBy("fold").agg(F.count_distinct("g").alias("n")).collect()}
    assert per_group == 1 and sizes == {**{i: 10 for i in range(9)}, 9: 13}


def test_more_folds_than_groups_puts_all_in_the_last(spark):
    out = splits.append_group_fold(spark.range(3), "id", 5)
    assert {r["fold"] for r in out.collect()} == {4}


def test_samples_are_balanced(spark):
    df = spark.range(100).select("id", (F.col("id") < 13).cast("int").alias("y"))
    down = splits.downsample(df, "y", "id").groupBy("y").count().collect()
    up = splits.upsample(df, "y", "id").groupBy("y").count().collect()
    assert {tuple(r) for r in down} == {(0, 13), (1, 13)} and {tuple(r) for r in up} == {(0, 87), (1, 87)}


def test_padding_gives_exact_width_and_keeps_every_row(spark):
    df = spark.range(40).select(
        F.when(F.col("id") < 25, "big").when(F.col("id") < 37, "mid").otherwise("small").alias("g"), "id",
        F.col("id").cast("double").alias("x"), F.lit(1).alias("is_win"),
    )
    out = reshape.pad_groups(df, "g", "id", ["x"], [], {"is_win": 0}).cache()
    sizes = {tuple(r) for r in out.groupBy("g", "block").agg(F.count("*"), F.sum("is_win")).collect()}
    assert sizes == {("big", 0, 18, 18), ("big", 1, 18, 7), ("mid", 0, 18, 12), ("small", 0, 18, 3)}
    assert {r["x"] for r in out.filter("g = 'small' AND is_padded = 1").collect()} == {38.0}


def test_group_rows_chunk_large_groups_without_loss(spark):
    df = spark.range(25).select(F.lit("g").alias("g"), "id", F.col("id").cast("double").alias("x"))
    out = reshape.group_rows(df, "g", "id", ["x"], "x", 10).orderBy("chunk").collect()
    assert [len(r["y"]) for r in out] == [10, 10, 5]
    assert [v for r in out for v in r["y"]] == [float(i) for i in range(25)]


def test_target_encoding_goes_from_prior_to_mean(spark):
    df = spark.range(2010).select(F.when(F.col("id") < 10, "rare").otherwise("common").alias("k"), (F.col("id") < 10).cast("double").alias("t"))
    got = {r["k"]: r["k_te"] for r in encode.target_encode(df, "k", "t").distinct().collect()}
    prior = 10 / 2010
    weight = 1 / (1 + math.exp(-(10 - 500) / 30))
    assert got["rare"] == pytest.approx(weight + (1 - weight) * prior) and got["common"] == pytest.approx(0.0, abs=1e-12)


def test_rare_codes(spark):
    df = frame(spark, [("a",)] * 3 + [("b",), (None,)], "c string")
    assert sorted(r["c"] for r in encode.fold_others(df, ["c"], keep_above=2).collect()) == ["a", "a", "a", "others", "others"]
    few = [r["c"] for r in encode.fold_few(df, ["c"], below=2).collect()]
    assert sorted(map(str, few)) == ["None", "a", "a", "a", "few"]


def test_one_hot_forms_agree(spark):
    df = frame(spark, [(1, "a"), (2, "b"), (3, "a")], "id int, c string")
    assert values(encode.one_hot(df, ["c"]), "id", "c_a", "c_b") == [(1, 0), (0, 1), (1, 0)]
    vectors = [r["c_vector"].toArray()[:2].tolist() for r in encode.one_hot_vector(df, ["c"]).orderBy("id").collect()]
    assert vectors == [[1, 0], [0, 1], [1, 0]]
    wide = encode.one_hot(df.withColumn("d", F.lit("x")), ["c", "d"], max_columns=2)  # the smaller code comes first
    assert wide.columns == ["id", "d_x", "c_vector"]
    assert [r["c_vector"].toArray()[:2].tolist() for r in wide.orderBy("id").collect()] == vectors


def test_fills_leave_nothing_missing(spark):
    df = frame(spark, [("a", 1.0, None), ("a", None, None), ("b", None, "x")], "g string, x double, c string")
    for filled in (nulls.fill_global(df, ["x"], ["c"]), nulls.fill_group(df, "g", ["x"], ["c"])):
        assert nulls.completeness(filled).first()[0] == 1.0


def test_slot_features(spark):
    df = frame(
        spark, [(1, None, 0.0, 3.0, 5.0), (2, None, 0.0, None, 5.0)],
        "id int, pre1_Pass1 double, pre1_Pass2 double, pre1_Pass3 double, pre1_Pass4 double",
    )
    out = features.append_corners(df, ["pre1"])
    assert values(out, "id", "first_corner_pass_pre1", "first_last_pass_delta_pre1") == [(3.0, 2.0), (None, None)]


def test_dates_codes_and_buckets(spark):
    df = frame(spark, [("20200301s", "20200228s"), ("20200101s", "20200301s"), ("junk", "20200101s")], "a string, b string")
    days = df.select(fc.elapsed_days(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in days] == [2.0, None, None]
    hoof = frame(spark, [("01s",), ("12s",), ("13s",), ("24s",), (None,)], "c string")
    assert [tuple(r) for r in hoof.select(fc.hoof_type(F.col("c")), fc.hoof_size(F.col("c"))).collect()] == [
        ("t1", "l"), ("t3", "qs"), ("o", "o"), ("t5", "qs"), ("o", "o"),
    ]
    length = frame(spark, [(999,), (1400,), (1401,), (2200,), (2599,), (2600,)], "d int")
    assert [r[0] for r in length.select(fc.distance_bucket(F.col("d"))).collect()] == [
        None, "sprint", "mile", "middle", "classic", "stayer",
    ]


def test_career_family_without_all_counts_is_left_alone(spark):
    names = [f"ei_{f}{p}" for f in ("Jra", "Inter", "Other") for p in ("First", "Second", "Third", "Lose")]
    df = frame(spark, [tuple([0] * 12) + (1,)], ", ".join(f"{n} long" for n in names) + ", ei_DistFirst long")
    out = features.roll_up_career(df).first().asDict()
    assert out["ei_DistFirst"] == 1 and "ei_DistTotal" not in out
    assert out["ei_TotalTotal"] == 0 and out["ei_TotalWinPer"] is None and "ei_JraFirst" not in out


def test_scaling_constant_column_is_zero(spark):
    df = spark.range(5).select(F.lit(2.0).alias("x"))
    assert {r["x"] for r in scaling.normalize(df, ["x"]).collect()} == {0.0}


def test_column_management(spark):
    df = frame(spark, [(1, 2.0, "x", float("nan"))], "b int, is_winner double, a string, c double")
    assert columns.codes_and_numbers(df, ["b"]) == (["a", "b"], ["c", "is_winner"])
    assert columns.feature_names(df) == ["a", "b", "c"]  # is_winner starts with is_win
    assert columns.nan_to_null(df).first()["c"] is None
    assert columns.numbers_codes_others(df, ["a"], ["c"]).columns == ["c", "a", "b", "is_winner"]
    assert columns.choose_columns(df, keep=["c"], process_features=["b"]).columns == ["b", "c"]
    with pytest.raises(ValueError):
        columns.drop_or_keep(df, remove=["a"], keep=["b"])
    assert columns.encoded_name("ri_Discipline") == "discipline" and columns.encoded_name("hoof_type") == "hoof_type"
    assert "li_WinOdds" not in columns.policy_process_features()


def test_pairwise_losses_match_brute_force(spark):
    pred, label = [0.2, -1.0, 0.7], [0.0, 3.0, 1.0]
    df = frame(spark, [("g", pred, label)], "g string, p array<double>, t array<double>")
    sig = lambda v: 1 / (1 + math.exp(-v))
    xent = softplus = 0.0
    for i in range(3):
        for j in range(3):
            term = 3 + math.log1p(math.exp(pred[j] - pred[i])) * math.tanh(label[j] - label[i])
            softplus += min(max(term, 0), 3)
            if i < j:
                p, t = sig(pred[i] - pred[j]), sig(label[i] - label[j])
                xent += -t * math.log(p) - (1 - t) * math.log(1 - p)
    assert evaluate.pairwise_cross_entropy(df, "g", "p", "t").first()["loss"] == pytest.approx(xent / 3)
    assert evaluate.pairwise_softplus(df, "g", "p", "t").first()["loss"] == pytest.approx(softplus / 9)


def test_threshold_sweep_next_to_cutoffs(spark):
    df = spark.range(51).select((F.col("id") / 50).alias("pred"), F.lit(1).alias("is_win"), F.lit(1).alias("is_place"), F.lit(100.0).alias("hr_PaybackWin"), F.lit(None).cast("double").alias("hr_PaybackPlace"))
    out = evaluate.threshold_sweep(df).orderBy("cutoff").collect()
    assert [r["buys"] for r in out] == [50 - i for i in range(50)]
    assert out[0]["win_return"] == 1.0 and out[0]["place_return"] == 0.0


@pytest.mark.parametrize("gap", [1000.0, -1000.0])
def test_pairwise_losses_of_large_gaps(spark, gap):
    rows = [("g", [0.0, gap], [0.0, -0.001])]
    df = spark.createDataFrame(rows, "g string, pred array<double>, label array<double>")
    entropy = evaluate.pairwise_cross_entropy(df, "g", "pred", "label").first()["loss"]
    first = 1 / (1 + math.exp(-0.001))
    # the side the scores are against is clipped at the smallest probability
    clipped = -math.log(1e-8)
    assert entropy == pytest.approx((first if gap > 0 else 1 - first) * clipped / 2, rel=1e-9)
    loss = evaluate.pairwise_softplus(df, "g", "pred", "label").first()["loss"]
    pairs = [0.0, 0.0]
    for a, b in ((0, 1), (1, 0)):
        y, t = rows[0][1], rows[0][2]
        x = y[b] - y[a]
        softplus = max(x, 0) + math.log1p(math.exp(-abs(x)))
        pairs[a] = min(max(2 + softplus * math.tanh(t[b] - t[a]), 0), 2)
    assert loss == pytest.approx((4 + sum(pairs)) / 4)


def test_row_split_does_not_follow_the_layout(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    found = [sorted(r[0] for r in splits.random_split(df.repartition(n), "k", 0.2, 3)[1].collect()) for n in (3, 7)]
    assert found[0] == found[1] and 300 < len(found[0]) < 500
