"""Boosting jobs on merged rows: same results as row by row, and fits that do not grow with the table."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from groupstats.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    """6,000 rows of 4 x 5 x 3 feature vectors; labels differ within each, some numbers and codes are missing."""
    h = F.xxhash64("id")
    df = spark.range(6000).select(
        "id", F.pmod(h, F.lit(4)).cast("double").alias("a"), F.when(F.pmod(h, F.lit(5)) > 0, F.pmod(h, F.lit(5))).alias("b"),
        F.when(F.pmod(h, F.lit(3)) > 0, F.concat(F.lit("c"), F.pmod(h, F.lit(3)).cast("string"))).alias("c"),
        (F.col("id") % 5).cast("int").alias("fold"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("noise"),
    )
    y = F.col("a") * 2 + F.coalesce(F.col("b"), F.lit(7)) ** 2 + (F.col("c").isNull()).cast("int") * 3 + F.col("noise") / 300
    return df.withColumn("y", y).withColumn("won", (y > 12).cast("int")).persist()


JOB = models.Boosting(["a", "b"], "y", codes=["c"], params={"maxIter": 3})
BINARY = replace(JOB, label="won", objective="binary")


def both(job):
    return replace(job, merge_above=10**9), replace(job, merge_above=0)


@pytest.mark.parametrize("job", [JOB, BINARY])
def test_merged_fit_scores_as_row_by_row(rows, job, monkeypatch):
    monkeypatch.setattr(models, "LOTS", 100)
    apart, merged = both(job)
    made = merged.preparation(rows)
    points = merged.rows(rows, made)
    assert made.cells and points.count() < 700 and points.agg(F.sum("_weight")).first()[0] == pytest.approx(6000)
    one, two = (models.score(models.fit_boosting(rows, j), rows).select("id", "pred").collect() for j in (apart, merged))
    assert dict(two) == pytest.approx(dict(one), abs=1e-9)


def test_merged_points_keep_sums_of_labels(rows):
    _, merged = both(JOB)
    points = merged.rows(rows, merged.preparation(rows))
    sums = lambda y, w: [F.sum(w), F.sum(w * y), F.sum(w * y * y)]
    kept = points.agg(*sums(F.col("y"), F.col("_weight"))).first()
    assert list(kept) == pytest.approx(list(rows.agg(*sums(F.col("y"), F.lit(1.0))).first()))


def test_merged_early_stop_and_folds(rows):
    train, valid = rows.filter("fold > 0"), rows.filter("fold = 0")
    one, two = (models.fit_boosting(train, replace(j, params={"maxIter": 30, "stepSize": 0.5}), valid) for j in both(JOB))
    assert one.stages[-1].getNumTrees == two.stages[-1].getNumTrees < 30


def test_merged_search_knows_the_number_of_rows(rows):
    trials = [{"maxDepth": 3}, {"maxDepth": 3, "minInstancesPerNode": 1300}, {"minInstancesPerNode": 3000}]
    one, two = (models.fold_metrics(rows, j, trials, 5) for j in both(JOB))
    assert two == pytest.approx(one) and one[0] < one[1] < one[2]


def test_merged_ablation(rows):
    one, two = (models.ablation(rows.filter("fold > 0"), rows.filter("fold = 0"), j).collect() for j in both(JOB))
    assert [r["feature"] for r in two] == ["a", "b", "c"]
    assert [r["score"] for r in two] == pytest.approx([r["score"] for r in one])
    assert [r["unnecessary"] for r in two] == [r["unnecessary"] for r in one]


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(20000).select((F.col("id") / 7).alias("x"), (F.col("id") >= 10000).cast("double").alias("y"))
    job = models.Boosting(["x"], "y", params={"maxIter": 2}, merge_above=0)
    made = job.preparation(df)
    assert 0 < made.cells <= 64
    out = models.score(models.fit_boosting(df, job), df)
    assert out.agg(F.avg((F.col("y") - F.col("pred")) ** 2)).first()[0] < 0.01


def test_drawn_rows_come_in_lots(rows, monkeypatch):
    monkeypatch.setattr(models, "DRAWN_LOTS", 1000)
    job = replace(JOB, params={"maxIter": 3, "subsamplingRate": 0.6}, merge_above=0)
    made = job.preparation(rows)
    assert job.draws_rows() and job.rows(rows, made, drawn=True).count() > 900
    metrics = models.fold_metrics(rows, job, [{}, {"subsamplingRate": 1.0}], 5)
    assert metrics[0] == pytest.approx(metrics[1], rel=0.2)
