"""Groups of more entries than the padded width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupstats.operators import evaluate, reshape


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(47).select(
        F.when(F.col("id") < 41, "big").otherwise("small").alias("g"), "id",
        ((F.col("id") * 37) % 11 / 11).alias("p"), ((F.col("id") * 13) % 7 / 7).alias("t"), F.lit(1).alias("w"),
    )


def test_no_entry_is_cut(df):
    out = reshape.pad_wide_groups(df, "g", "id", ["p"], [], {"w": 0}).cache()
    sizes = {tuple(r) for r in out.groupBy("g", "block").agg(F.count("*"), F.sum("w")).collect()}
    assert sizes == {("big", 0, 18, 18), ("big", 1, 18, 18), ("big", 2, 18, 5), ("small", 0, 18, 6)}
    mean = df.filter("g = 'big'").agg(F.avg("p")).first()[0]
    padded = [r["p"] for r in out.filter("g = 'big' AND is_padded = 1").collect()]
    assert padded == pytest.approx([mean] * 13)


def test_losses_count_pairs_between_blocks(df):
    """As in one block that holds the group and the same padding."""
    cut = lambda width: reshape.to_tensors(
        reshape.pad_wide_groups(df.filter("g = 'big'"), "g", "id", ["p", "t"], width=width), "g", ["p"], labels=["p", "t"]
    )
    for loss in (evaluate.pairwise_cross_entropy, evaluate.pairwise_softplus):
        whole = loss(cut(54).drop("block"), "g", "p", "t").first()["loss"]
        assert loss(cut(18), "g", "p", "t").first()["loss"] == pytest.approx(whole)


@pytest.fixture
def heavy_groups(spark):
    spark.conf.set("spark.groupstats.heavyRows", "20")
    yield
    spark.conf.unset("spark.groupstats.heavyRows")


def shuffled(df, width=18):
    return reshape.pad_groups(df, "g", "id", ["p"], [], {"w": 0}, width=width, seed=4)


def test_padding_is_shuffled_in(spark):
    """Over many groups every place holds padding about as often; none holds only entries or only padding."""
    df = spark.range(4000).select((F.col("id") % 500).alias("g"), "id", F.col("id").cast("double").alias("p"), F.lit(1).alias("w"))
    places = shuffled(df, 10).groupBy("pos").agg(F.avg("is_padded").alias("share")).collect()
    assert len(places) == 10 and all(0.12 < r["share"] < 0.28 for r in places)


def test_heavy_groups_are_padded_alike(df, heavy_groups, spark):
    heavy = {tuple(r) for r in shuffled(df).collect()}
    spark.conf.unset("spark.groupstats.heavyRows")
    assert heavy == {tuple(r) for r in shuffled(df).collect()}


def test_tensors_are_the_padded_rows(df):
    blocks = reshape.group_blocks(df, "g", "id", ["p", "t"], [], {"w": 0}, seed=4)
    direct = {r["g"] + str(r["block"]): r.asDict() for r in reshape.block_tensors(blocks, "g", ["p"], labels=["t", "w"]).collect()}
    again = reshape.to_tensors(reshape.pad_groups(df, "g", "id", ["p", "t"], [], {"w": 0}, seed=4), "g", ["p"], labels=["t", "w"])
    for row in again.collect():
        mine = direct.pop(row["g"] + str(row["block"]))
        assert mine.pop("blocks") == (3 if row["g"] == "big" else 1) and mine == row.asDict()
    assert not direct


@pytest.mark.parametrize("stripe", [1, 40, 1024])
def test_losses_of_a_large_group(spark, monkeypatch, stripe):
    """A group cut into many stripes against all its pairs at once."""
    monkeypatch.setattr(evaluate, "STRIPE", stripe)
    n, width = 400, 18
    df = spark.range(n).select(F.lit("g").alias("g"), "id", (F.sin("id") * 3).alias("p"), F.cos(F.col("id") * 2).alias("t"))
    tensors = reshape.block_tensors(reshape.group_blocks(df, "g", "id", ["p", "t"], width=width, seed=1), "g", ["p"], labels=["p", "t"])
    rows = tensors.collect()
    p, t = (np.concatenate([r[c] for r in rows]) for c in ("p", "t"))
    w = len(p)
    assert w == 414
    gap, label = p[:, None] - p[None, :], t[:, None] - t[None, :]
    first = 1 / (1 + np.exp(-label))
    entropy = -first * np.maximum(-np.logaddexp(0, -gap), np.log(1e-8)) - (1 - first) * np.maximum(-np.logaddexp(0, gap), np.log(1e-8))
    soft = np.clip(w + np.logaddexp(0, -gap) * np.tanh(-label), 0, w)
    assert evaluate.pairwise_cross_entropy(tensors, "g", "p", "t").first()["loss"] == pytest.approx(np.triu(entropy, 1).sum() / w)
    assert evaluate.pairwise_softplus(tensors, "g", "p", "t").first()["loss"] == pytest.approx(soft.sum() / w**2)
    # without the number of blocks it is counted
    assert evaluate.pairwise_softplus(tensors.drop("blocks"), "g", "p", "t").first()["loss"] == pytest.approx(soft.sum() / w**2)


def test_missing_values_make_the_loss_null(spark):
    df = spark.range(60).select(
        F.when(F.col("id") < 50, "big").otherwise("small").alias("g"), "id",
        F.when(F.col("id") != 7, F.col("id") / 60).alias("p"), (F.col("id") % 5).alias("t"),
    )
    tensors = reshape.block_tensors(reshape.group_blocks(df, "g", "id", ["p", "t"], seed=1), "g", ["p"], labels=["p", "t"])
    for loss in (evaluate.pairwise_cross_entropy, evaluate.pairwise_softplus):
        found = {r["g"]: r["loss"] for r in loss(tensors, "g", "p", "t").collect()}
        assert found["big"] is None and found["small"] is not None


def test_groups_of_nothing(spark):
    none = spark.createDataFrame([], "g string, id long, p double, t double")
    blocks = reshape.group_blocks(none, "g", "id", ["p", "t"], seed=1)
    tensors = reshape.block_tensors(blocks, "g", ["p"], labels=["p", "t"])
    assert blocks.count() == 0 and evaluate.pairwise_softplus(tensors, "g", "p", "t").count() == 0
