"""Profiles by part, merged, against the whole table."""

import pytest
from pyspark.sql import functions as F

from groupstats.operators.profiles import merge_profiles, sketch_columns


def test_parts_merge_to_the_whole(spark):
    df = spark.range(50_000).select(
        (F.col("id") % 7).alias("part"), F.when(F.col("id") % 5 > 0, F.col("id") + 1e9).alias("x"),
        (F.col("id") % 300).cast("string").alias("few"), F.lit(None).cast("double").alias("none"), F.col("id").alias("cell_0"),
    )
    columns = ["x", "few", "none", "cell_0"]
    parts = sketch_columns(df, columns, by=["part"])
    assert parts.count() == 28
    made = {r["column"]: r for r in merge_profiles(parts).collect()}
    want = df.agg(F.avg("x"), F.stddev_samp("x"), F.max("x")).first()
    x = made["x"]
    assert (x["rows"], x["nulls"], x["largest"], x["largest_text"]) == (50_000, 10_000, want[2], None)
    assert x["mean"] == pytest.approx(want[0]) and x["std"] == pytest.approx(want[1])
    assert abs(x["distinct_values"] - 40_000) < 0.04 * 40_000
    assert (made["few"]["distinct_values"], made["few"]["largest_text"], made["few"]["mean"]) == (300, "99", None)
    assert (made["none"]["nulls"], made["none"]["distinct_values"], made["none"]["mean"], made["none"]["std"]) == (50_000, 0, None, None)


def test_one_scan_one_aggregate_and_empty_tables(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert {(r["column"], r["rows"], r["distinct_values"]) for r in merge_profiles(sketch_columns(df, ["a", "b"])).collect()} == {
        ("a", 0, 0), ("b", 0, 0),
    }
    assert merge_profiles(sketch_columns(df, ["a"], by=["b"])).count() == 0


def test_profile_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 2).alias("v")).write.parquet(path)
    made = sketch_columns(spark.read.parquet(path), ["id", "v"], by=["k"])
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1
