"""Heavy keys: the sketch, tables split once for a chain, ranks by value, draws by directory."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from groupstats.operators import evaluate, groups, ranks, reshape
from groupstats.skew import Fitted, SplitFrame, attach_many, find_heavy, number_sorted, running_total, split


@pytest.fixture
def limits(spark):
    def put(**values):
        for name, value in values.items():
            spark.conf.set(f"spark.groupstats.{name}", str(value))

    yield put
    for name in ("heavyRows", "maxHeavy", "smallRows"):
        spark.conf.unset(f"spark.groupstats.{name}")


def test_sketch_finds_the_keys_above_the_limit(spark, limits):
    limits(heavyRows=90, maxHeavy=50)
    df = spark.range(6000).select(
        F.when(F.col("id") < 300, "a").when(F.col("id") < 400, None).when(F.col("id") < 490, "at most").when(F.col("id") < 581, "b").otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") % 2).alias("j"),
    )
    assert {r["k"] for r in find_heavy(df, "k").rows.collect()} == {"a", None, "b"}
    assert {tuple(r) for r in find_heavy(df, ["k", "j"]).rows.collect()} == {("a", 0), ("a", 1)}
    limits(maxHeavy=1)
    assert [r["k"] for r in find_heavy(df, "k").rows.collect()] == ["a"]
    assert find_heavy(df.limit(0), "k").rows is None and find_heavy(df.filter("k >= '5'").filter("k < 'a'"), "k").rows is None


def test_search_moves_no_keys(spark):
    """The sketches are all that is shuffled: one row for every task."""
    df = spark.range(1000).select((F.col("id") % 7).alias("k"))
    plan = df.select(F.xxhash64("k").alias("h")).agg(F.expr("approx_top_k(h, 10, 10)"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in text and "hashpartitioning" not in text


def rows(spark, n=500):
    return spark.range(n).select(
        F.when(F.col("id") % 5 > 0, "big").when(F.col("id") % 10 > 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("g"), "id",
        F.when(F.col("id") % 13 > 0, F.col("id") * 37 % 101).cast("double").alias("time"), F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 23 / 2).alias("odds"),
        F.when(F.col("id") % 17 > 0, F.col("id") % 3).cast("double").alias("pred"), (F.col("id") % 2).alias("buy"), (F.col("id") % 7 / 3).alias("y"),
    )


def chain(df):
    df = groups.append_margin(df, "g", "time")
    df = ranks.append_popularity(df, "g", "odds", "id")
    df = ranks.append_pred_order(df, "g")
    df = ranks.append_pick(df, "g", "pred", "id")
    df = groups.append_group_zscore(df, "g", ["time", "odds"])
    df = groups.drop_groups_zero_sum(df, "g", "y")
    return evaluate.append_rewards(df, "g")


def test_chain_on_a_split_table(spark, limits):
    df = rows(spark)
    rounded = lambda out: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in out.collect())
    plain = rounded(chain(df))
    limits(heavyRows=30)
    cut = split(df, "g")
    assert cut.large is not None and cut.large.count() == 450 and cut.rest.count() == 50
    made = chain(cut)
    assert isinstance(made, SplitFrame) and rounded(made.merged()) == plain
    assert rounded(chain(df)) == plain
    with pytest.raises(ValueError):
        groups.append_margin(cut, "id", "time")


def test_chain_scans_its_input_once(spark, limits, tmp_path):
    """Whatever the chain's length: once in the plan of the ordinary rows, and not at all in that of the heavy ones."""
    path = str(tmp_path / "t")
    rows(spark).write.parquet(path)
    limits(heavyRows=30)
    cut = split(spark.read.parquet(path), "g")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    one, many = groups.append_margin(cut, "g", "time"), chain(cut)
    assert scans(one.merged()) == scans(many.merged()) == 1
    assert scans(many.large) == 0


def test_rank_of_one_prediction_shared_by_many(spark, limits):
    """40,000 entries of one group, most with one prediction, spread over the partitions."""
    limits(heavyRows=1000, smallRows=10)
    df = spark.range(0, 40_000, 1, 8).select(F.lit("g").alias("g"), "id", F.when(F.col("id") % 100 > 0, 0.5).otherwise(F.col("id") / 40_000).alias("pred"))
    cut = split(df, "g")
    out = ranks.append_pred_order(cut, "g")
    values = {r["pred"]: r["n"] for r in df.groupBy("pred").agg(F.count("*").alias("n")).collect()}
    got = {(r["pred"], r["pred_order"]) for r in out.merged().collect()}
    lower, want = 0, set()
    for value in sorted(values):
        want.add((value, lower + 1))
        lower += values[value]
    assert got == want
    sizes = [len(p) for p in out.large.select("pred_order").rdd.glom().collect()]
    assert max(sizes) < 40_000 / 2


@pytest.mark.parametrize("n", [0, 1, 300])
def test_running_total(spark, n):
    df = spark.range(n).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 5 % 7).alias("v")).repartition(5)
    by = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("t", F.coalesce(F.sum("v").over(by), F.lit(0))).collect()
    assert sorted(running_total(df, ["k"], [F.col("id").asc()], "v", "t").collect()) == sorted(want)
    assert number_sorted(df, ["k"], [F.col("id").asc()], "i").count() == n


def test_draws_follow_the_ranks_of_digests(spark, limits):
    from groupstats.skew import hash_of

    df = spark.range(70).select((F.col("id") % 23).alias("g"), "id")
    order = [r["g"] for r in df.select("g", hash_of(["g"], 3).alias("d")).distinct().orderBy("d").collect()]
    numbers = spark.range(400).select(F.floor(F.col("id") / 2).cast("int").alias("draw"), (F.col("id") % 2).cast("int").alias("part"))
    numbers = numbers.withColumn("n", F.conv(F.substring(hash_of(["draw", "part"], 3), 1, 12), 16, 10).cast("long")).collect()
    members = {g: sorted(r["id"] for r in df.filter(F.col("g") == g).collect()) for g in order}
    want = sorted((r["draw"], r["part"], i) for r in numbers for i in members[order[r["n"] % 23]])
    for small in (100_000, 10):
        limits(smallRows=small)
        drawn = reshape.draw_groups(df, "g", draws=200, per_draw=2, seed=3)
        assert sorted((r["draw"], r["part"], r["id"]) for r in drawn.collect()) == want
    assert reshape.draw_groups(df.limit(0), "g", 5).count() == 0


def test_lookups_of_many_tables(spark, limits):
    """Some tables are broadcast and the others met by one join, however many they are."""
    draw = [(k, k % 3, k % 50, None if k % 7 == 0 else k % 11) for k in range(200)]
    df = spark.createDataFrame(draw, "id long, a int, b int, c int").repartition(4)
    table = spark.createDataFrame(
        [(n, str(v), float(v * 10)) for n, size in (("a", 2), ("b", 50), ("c", 11)) for v in range(size)], "t string, k string, x double"
    )
    keys = {n: F.col(n).cast("string") for n in "abc"}
    found = {}
    for small, heavy, whole in ((100_000, 1000, True), (15, 1000, False), (0, 20, False)):
        limits(smallRows=small, heavyRows=heavy)
        out = attach_many(df, Fitted(table, whole), "t", "k", keys)
        found[small] = sorted((r["id"], *[r[f"_got_{n}"] and r[f"_got_{n}"]["x"] for n in "abc"]) for r in out.collect())
        assert out.columns == [*df.columns, "_got_a", "_got_b", "_got_c"]
        assert attach_many(df, Fitted(table, whole), "t", "k", keys, "inner").count() == sum(a < 2 and c is not None for _, a, _, c in draw)
    value = lambda v, size: v * 10.0 if v is not None and v < size else None
    assert found[100_000] == found[15] == found[0] == [(i, value(a, 2), value(b, 50), value(c, 11)) for i, a, b, c in draw]


def test_joins_of_lookups_do_not_grow_with_their_number(spark, limits):
    limits(smallRows=0)
    table = spark.createDataFrame([(f"t{n}", str(v), 1.0) for n in range(30) for v in range(9)], "t string, k string, x double")
    df = spark.range(50).select("id", (F.col("id") % 9).cast("string").alias("k"))
    joins = []
    for n in (3, 30):
        out = attach_many(df, Fitted(table, False), "t", "k", {f"t{i}": F.col("k") for i in range(n)})
        joins.append(out._jdf.queryExecution().optimizedPlan().toString().count("Join "))
    assert joins[0] == joins[1]


def test_lookups_store_rows_as_narrow_as_given(spark, limits, monkeypatch):
    """What is found by broadcast is not carried through the join of the large tables."""
    from groupstats import skew

    stored, seen = skew.stored, []
    monkeypatch.setattr(skew, "stored", lambda df, name: seen.append(df.columns) or stored(df, name))
    limits(smallRows=2)
    table = spark.createDataFrame([(n, str(v), 1.0) for n, size in (("a", 2), ("b", 9)) for v in range(size)], "t string, k string, x double")
    df = spark.range(20).select("id", (F.col("id") % 2).cast("string").alias("a"), (F.col("id") % 9).cast("string").alias("b"))
    out = attach_many(df, Fitted(table, False), "t", "k", {n: F.col(n) for n in "ab"})
    assert seen == [["id", "a", "b", "_row"]] and out.filter("_got_a.x + _got_b.x = 2").count() == 20
