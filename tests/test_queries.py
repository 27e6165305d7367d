"""Every query against its SQL on the smallest test tables."""

import pytest

import __spark_entry__ as entry_points
from compare import database, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in entry_points.queries().items() if k not in entry_points.TEXT_QUERIES}
ORACLES = {k: v for k, v in entry_points.oracle_sql().items() if k not in entry_points.TEXT_ORACLES}
ROWS_ONLY = {
    "gbt_fit_score", "gbt_cv", "gbt_folds", "feature_importance", "ablation",
}
# queries whose operators split off heavy groups or attach fitted tables
SKEWED = [
    "group_zscore", "margin_targets", "fill_group", "code_share", "target_encode", "fold_rare_others", "label_encode",
    "popularity_order", "pred_rank", "top1_pick", "leave_one_out", "group_rows", "first_corner", "keep_groups",
    "target_encode_many", "slot_zscore", "fold_rare_few", "group_chain", "pairwise_xent_wide", "draw_groups", "stream_apply",
]


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql_or_is_random():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    ours = QUERIES[name](spark, FOLDER).toArrow()
    assert difference(ours, con.sql(ORACLES[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", SKEWED)
def test_query_equals_sql_when_all_groups_are_heavy(spark, con, heavy_everything, name):
    ours = QUERIES[name](spark, FOLDER).toArrow()
    assert difference(ours, con.sql(ORACLES[name]).to_arrow_table()) is None


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() == 2
