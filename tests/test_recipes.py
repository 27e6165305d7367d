"""The three end-to-end runs on a small racing table."""

import pytest
from pyspark.sql import functions as F

from groupstats.functions import fixed
from groupstats.plans import recipes
from racing import CODES, entry_table


@pytest.fixture(scope="module")
def entries(spark):
    return entry_table(spark).cache()


def test_boosted_tree_run(spark, entries, tmp_path):
    rows = recipes.boosted_tree_rows(entries, str(tmp_path), "entry", CODES, keep_above=3).cache()
    assert rows.count() == entries.count()
    names = set(rows.columns)
    assert {"margin", "pops_order", "nige_ratio", "avg3_TimeDelta", "elapsed_time", "ei_TotalWinPer"} <= names
    assert "pre2_TimeDelta" not in names and "pre1_TimeDelta_Distance_tmp_score" in names
    assert "discipline_hoof_type_te_margin" in names
    labels = ["hi_RaceID", "entry", "margin", "is_win", "is_place", "hr_PaybackWin", "hr_PaybackPlace"]
    few = rows.select(*labels, "avg3_TimeDelta", "nige_ratio", "hoof_type", "weight_delta")
    scores, summary, _, scored = recipes.boosted_tree_run(few, "entry", folds=2, params={"maxIter": 1})
    assert scores.count() == 2 and summary.count() == 1
    assert scored.filter("pred IS NULL").count() == 0


def test_tensor_groups(spark, entries, tmp_path):
    train, test = recipes.tensor_groups(entries, str(tmp_path), "entry", CODES, few_below=2)
    assert train.count() + test.count() == entries.select("hi_RaceID").distinct().count()
    widths = train.unionByName(test).select(
        F.size("main").alias("w"), F.size("margin").alias("l"), F.size("hoof_type").alias("c")
    )
    assert {tuple(r) for r in widths.collect()} == {(fixed.GROUP_WIDTH,) * 3}


def test_policy_groups(spark, entries, tmp_path):
    train, test, sizes = recipes.policy_groups(entries, str(tmp_path), "entry", CODES, few_below=2)
    assert train.filter("ri_Year >= 2017").count() == 0 and test.filter("ri_Year < 2017").count() == 0
    assert "has_pre1" in train.columns and "has_li" not in train.columns
    assert sizes.filter("width < 1 OR max_code < 0").count() == 0
    kept = train.groupBy("hi_RaceID").agg(F.sum("hr_PaybackPlace").alias("s"))
    assert kept.filter("s = 0").count() == 0
