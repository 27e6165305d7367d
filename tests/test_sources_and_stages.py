"""Declared schemas, scans, sinks, staged runs, streaming and models."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupstats.operators import models
from groupstats.plans import fitted
from groupstats.plans.stages import FitStage, FittedStage, StagedRun
from groupstats.sources import files, schema
from groupstats.streaming.apply import apply_to_stream, read_entries


def test_schema_guards_labels_and_scan_reads_only_declared_columns(spark, tmp_path):
    (tmp_path / "types.csv").write_text("hi_RaceID,object\nx,float64\nhr_Secret,int64\nhr_Distance,int64\n")
    (tmp_path / "rows.csv").write_text("x,hr_Secret,hi_RaceID,hr_Distance\n1.5,7,01s,1200\nNaN,7,02s,\n")
    declared = schema.load_schema(spark, str(tmp_path / "types.csv"))
    assert declared.names == ["hi_RaceID", "x", "hr_Distance"]
    assert schema.codes_and_numbers(declared) == (["hi_RaceID"], ["hr_Distance", "x"])
    df = files.read_csv(spark, str(tmp_path / "rows.csv"), declared)
    assert [tuple(r) for r in df.orderBy("hi_RaceID").collect()] == [("01s", 1.5, 1200), ("02s", None, None)]
    assert files.read_csv(spark, str(tmp_path / "rows.csv"), declared, rows=1).count() == 1
    files.convert_csv(spark, str(tmp_path / "rows.csv"), str(tmp_path / "table"), declared)
    assert files.read_table(spark, str(tmp_path / "table")).count() == 2


def test_csv_files_of_several_layouts(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b,c\n1,x,1.5\n2,NA,nan\n3,\"p, q\",\n")
    (folder / "2.csv").write_text("\ufeffc,more,a,b\n2.5,7,4,y\n1e3,8,5.0,null\n")
    (folder / "3.csv").write_text("")
    (folder / "4.csv").write_text("b,c,a\n")
    declared = T.StructType.fromDDL("a int, b string, c double")
    read = lambda **more: sorted(tuple(r) for r in files.read_csv(spark, str(folder), declared, **more).collect())
    want = [(1, "x", 1.5), (2, None, None), (3, "p, q", None), (4, "y", 2.5), (5, None, 1000.0)]
    assert read() == want and files.bad_values(spark, str(folder), declared).count() == 0
    (folder / "5.csv").write_text("b,c,a\nz,1,5\n\"w\",about 3,6.5\n")
    anyhow = {tuple(r) for r in files.read_csv(spark, str(folder), declared, bad="null").collect()}
    assert anyhow == {*want, (5, "z", 1.0), (None, "w", None)}
    found = {tuple(r)[1:] for r in files.bad_values(spark, str(folder), declared).collect()}
    assert found == {("a", "6.5", '{"b":"w","c":"about 3","a":"6.5"}'), ("c", "about 3", '{"b":"w","c":"about 3","a":"6.5"}')}
    with pytest.raises(Exception, match="column [ac] in"):
        read()
    (folder / "6.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="columns not in"):
        read()


def test_lists(spark, tmp_path):
    (tmp_path / "list.csv").write_text("b\n\n# note\na\n")
    assert schema.load_removes(spark, str(tmp_path / "list.csv")) == ["a", "b"]
    (tmp_path / "keep.csv").write_text("b\na\n")
    assert schema.load_keeps(spark, str(tmp_path / "keep.csv")) == ["a", "b"]


def test_sinks(spark, tmp_path):
    files.write_scored(spark.range(3), spark.range(2), str(tmp_path / "scored"))
    counts = spark.read.parquet(str(tmp_path / "scored")).groupBy("split").count().collect()
    assert {tuple(r) for r in counts} == {("train", 3), ("test", 2)}
    files.write_sample(spark.range(4), str(tmp_path / "sample"))
    assert spark.read.csv(str(tmp_path / "sample"), header=True).count() == 4


def test_staged_run_keeps_results_and_fits_on_training_rows(spark, tmp_path):
    calls = []

    def double(df):
        calls.append(1)
        return df.withColumn("x", F.col("x") * 2)

    def run():
        return StagedRun(str(tmp_path)).add(double, name="double").add(fitted.global_fill(["x"]), name="fill")

    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    first = run()
    assert sorted(r["x"] for r in first.fit_gene(train).collect()) == [2.0, 4.0, 6.0]
    new = spark.createDataFrame([(None,)], "x double")
    assert first.apply(new).first()["x"] == 4.0  # the mean of the training rows
    second = run()
    second.fit_gene(train)
    assert len(calls) == 2  # once to fit, once to apply; the second run read the table
    assert second.models["fill"].state == {"x": 4.0}  # and the model


@pytest.mark.parametrize("stage, column", [
    (fitted.global_fill(["x"], ["c"]), "x"), (fitted.global_scale(["x"]), "x"), (fitted.target_means("c", "x", "te", smoothing=False), "te"),
    (fitted.rare_fold(["c"], keep_above=2), "c"), (fitted.labels(["c"]), "c"),
])
@pytest.mark.parametrize("small", [100_000, 1])
def test_saved_stages_give_equal_rows_in_another_session(spark, tmp_path, stage, column, small):
    spark.conf.set("spark.groupstats.smallRows", str(small))
    try:
        train = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("b", None), (None, 4.0), ("a", 7.0)], "c string, x double")
        new = spark.createDataFrame([("a", None), ("b", 3.0), ("z", 9.0), (None, 1.0)], "c string, x double")
        model = stage.fit(train)
        rows = lambda m: sorted(map(repr, m.transform(new).select(column).collect()))
        model.save(str(tmp_path / "model"))
        stage.save(str(tmp_path / "stage"))
        Pipeline(stages=[stage]).fit(train).save(str(tmp_path / "pipeline"))
        other = spark.newSession()
        other.createDataFrame([(1,)], "a int").count()
        loaded = FittedStage.load(str(tmp_path / "model"))
        assert rows(loaded) == rows(model) and loaded.uid == model.uid
        assert rows(FitStage.load(str(tmp_path / "stage")).fit(train)) == rows(model)
        assert rows(PipelineModel.load(str(tmp_path / "pipeline"))) == rows(model)
    finally:
        spark.conf.unset("spark.groupstats.smallRows")


def test_changed_parameters_and_input_run_stages_again(spark, tmp_path):
    calls = []

    def add(df, n):
        calls.append(f"add {n}")
        return df.withColumn("x", F.col("x") + n)

    def double(df):
        calls.append("double")
        return df.withColumn("x", F.col("x") * 2)

    def run(n, path="in"):
        calls.clear()
        staged = StagedRun(str(tmp_path / "kept")).add(add, {"n": n}, name="add").add(double, name="double")
        found = sorted(r["x"] for r in staged.fit_gene(spark.read.parquet(str(tmp_path / path))).collect())
        return found, list(calls)

    spark.createDataFrame([(1.0,), (2.0,)], "x double").write.parquet(str(tmp_path / "in"))
    assert run(1) == ([4.0, 6.0], ["add 1", "double"])
    assert run(1) == ([4.0, 6.0], [])
    assert run(3) == ([8.0, 10.0], ["add 3", "double"])
    assert run(1) == ([4.0, 6.0], [])
    spark.createDataFrame([(5.0,)], "x double").write.mode("append").parquet(str(tmp_path / "in"))
    assert run(1) == ([4.0, 6.0, 12.0], ["add 1", "double"])


def test_refit_computes_anew(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    new = spark.createDataFrame([(9.0,), (None,)], "x double")
    kept = fitted.global_fill(["x"]).fit(train).transform(new)
    anew = fitted.global_fill(["x"], refit=True).fit(train).transform(new)
    assert sorted(r["x"] for r in kept.collect()) == [2.0, 9.0]
    assert sorted(r["x"] for r in anew.collect()) == [9.0, 9.0]


def test_stream_restart_writes_nothing_twice(spark, tmp_path):
    spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("t")).write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    stage = fitted.target_means("k", "t", "te", smoothing=False).fit(rows)
    for _ in range(2):
        stream = read_entries(spark, f"{tmp_path}/in", rows.schema)
        apply_to_stream(stream, stage, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 10 and {tuple(r) for r in out.select("k", "te").distinct().collect()} == {(0, 4.0), (1, 5.0)}


def test_boosting_beats_the_mean_takes_nulls_and_saves_the_best(spark, tmp_path):
    df = spark.range(400).select(
        F.when(F.col("id") % 10 != 0, (F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 7).cast("double").alias("y")
    )
    job = models.Boosting(["x"], "y", params={"maxIter": 3})
    model = models.fit_boosting(df, job)
    scored = models.score(model, df)
    error, spread = scored.agg(F.avg((F.col("y") - F.col("pred")) ** 2), F.var_pop("y")).first()
    assert error < spread / 2
    again = models.score(models.fit_boosting(df, job), df)
    assert scored.exceptAll(again).count() == 0
    path = str(tmp_path / "model")
    assert models.keep_best(model, 0.5, None, path) == 0.5 and models.keep_best(model, 0.4, 0.5, path) == 0.5
    assert (tmp_path / "model").exists()
    trials = models.random_trials({"maxDepth": [2, 3]}, 3)
    assert len(trials) == 3 and all(t["maxDepth"] in (2, 3) for t in trials)
