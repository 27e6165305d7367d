"""Queries that read their joined entries several times work the joins out once."""

import pytest
from pyspark.sql import functions as F

from groupstats.operators import models
from groupstats.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    i = F.col("id")
    spark.range(300).select(
        F.floor(i / 3).alias("l_orderkey"), (i % 20).alias("l_partkey"), (i % 5).alias("l_suppkey"), (i % 3 + 1).cast("int").alias("l_linenumber"),
        (i % 50 + 1).cast("double").alias("l_quantity"), (i * 7.25 + 900).alias("l_extendedprice"), (i % 11 / 100).alias("l_discount"),
        (i % 9 / 100).alias("l_tax"), F.substring(F.lit("ANR"), (i % 3 + 1).cast("int"), F.lit(1)).alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.timestamp_seconds(800000000 + i * 86400).alias("l_shipdate"),
    ).write.parquet(f"{path}/lineitem.parquet")
    spark.range(100).select(
        i.alias("o_orderkey"), (i % 9).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), (i * 1.5).alias("o_totalprice"),
        F.timestamp_seconds(800000000 + i * 3000000).alias("o_orderdate"), F.concat((i % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority"),
    ).write.parquet(f"{path}/orders.parquet")
    spark.range(20).select(
        i.alias("p_partkey"), F.concat(F.lit("name "), i % 6).alias("p_name"), F.concat(F.lit("Brand#"), i % 5).alias("p_brand"),
        F.concat(F.lit("type "), i % 4).alias("p_type"), (i % 50 + 1).cast("int").alias("p_size"), (i + 900.5).alias("p_retailprice"),
    ).write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["max_code", "embedding_width", "merged_profile", "gbt_fit_score"])
def test_result_reads_the_stored_rows(spark, folder, name):
    out = QUERIES[name](spark, folder)
    assert not [f for f in out.inputFiles() if "lineitem.parquet" in f or "orders.parquet" in f]
    assert out.count() > 0


def test_held_out_folds_decide_the_number_of_rounds(spark, folder, monkeypatch):
    fitted, fit = [], models.fit_boosting

    def kept(train, job, valid):
        fitted.append((fit(train, job, valid), train, valid, job))
        return fitted[-1][0]

    monkeypatch.setattr(models, "fit_boosting", kept)
    assert QUERIES["gbt_folds"](spark, folder).count() == 5
    rounds = [model.stages[-1].getNumTrees for model, *_ in fitted]
    assert len(rounds) == 5 and min(rounds) > 2 and max(rounds) < 20_000
    model, train, valid, job = fitted[0]
    one_more = models.Boosting(job.features, job.label, params={"maxIter": rounds[0] + 1})
    error = lambda m: models.score(m, valid).agg(F.avg((F.col("label") - F.col("pred")) ** 2)).first()[0]
    assert error(model) <= error(fit(train, one_more)) + 1e-8
