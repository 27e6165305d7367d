"""Boosted-tree jobs on MLlib: fit, score, cross-validate, search, importance, ablation."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from math import prod

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groupstats.operators.evaluate import fold_summary, top1_report
from groupstats.operators.splits import fold_frames
from groupstats.session import checkpoints

METRICS = ["win_hit", "place_hit", "win_return", "place_return"]
#: What a job learns with unless told otherwise.
DEFAULTS = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "seed": 32}
#: As many rounds as the validation rows want: the reference's most, and the first one that does not make their error less.
#: (MLlib's own tolerance of 0.01 counts errors below 0.01 as 0.01 and can end a fit at its first tree; with 0, equal errors go on.)
UNTIL_WORSE = {"maxIter": 20_000, "validationTol": 1e-6}
WEIGHT = "_weight"
#: Merged rows there should be at least: without and with trees that draw rows, which then draw lots of rows.
LOTS, DRAWN_LOTS = 1 << 16, 1 << 20
#: Rows of a task in fits of many rounds: starting smaller ones, some seven times a round, takes longer than they run.
ROWS_A_TASK = 1 << 18


@dataclass(frozen=True)
class Preparation:
    """Transformers that make the columns of the feature vector, and what is known of the training rows.

    ``cells`` is about how many different vectors there are, 0 if rows are to be learned one by one.
    """

    stages: Sequence[Transformer]
    inputs: Sequence[str]
    cells: int = 0

    def assembler(self, left_out: str | None = None) -> VectorAssembler:
        inputs = [c for c in self.inputs if _source(c) != left_out]
        return VectorAssembler(inputCols=inputs, outputCol="_features")


def _source(name: str) -> str:
    """The column behind one of the vector."""
    return next(name.removeprefix(p) for p in ("_in_", "_missing_", "_code_") if name.startswith(p))


@dataclass(frozen=True)
class Boosting:
    """What is learned: a regression or a binary label, from which columns.

    ``features`` are numbers. A missing (or NaN) one is told to the trees: it takes the mean of the training rows, and
    each column with missing values there has a flag of its own beside it. ``codes`` are nominal: trees split them by sets of values.
    Of each, the ``max_bins - 2`` most frequent values are told apart; all others and NULL are one value.
    ``params`` go to the MLlib learner, such as ``subsamplingRate`` (rows) and ``featureSubsetStrategy`` (columns).

    Trees see a number only by its bin. So in a table of more than ``merge_above`` rows, numbers of more than ``max_bins`` values
    are cut at quantiles of all rows, and rows that are alike then are learned as one with their number as weight: a fit grows
    with the different vectors and not with the table. Labels keep their number, sum and sum of squares, all that squared loss
    depends on; other losses merge rows of one label only. Tables with too few rows alike are learned row by row.
    """

    features: Sequence[str]
    label: str
    objective: str = "regression"
    params: Mapping[str, object] | None = None
    codes: Sequence[str] = ()
    max_bins: int = 64
    merge_above: int = 100_000

    def _params(self, more: Mapping[str, object]) -> dict[str, object]:
        return {**DEFAULTS, "maxBins": self.max_bins, **(self.params or {}), **more}

    def learner(self, weight: float | None = None, **more: object):
        """The MLlib learner; ``weight`` is the number of training rows if they come merged."""
        kind = {"regression": GBTRegressor, "binary": GBTClassifier}[self.objective]
        params = self._params(more)
        if weight is not None:
            params["weightCol"] = WEIGHT
            least = params.pop("minInstancesPerNode", 1)  # MLlib counts merged rows there, so it is told as a share of the weight
            share = (least - 0.5) / max(weight, 1.0)
            if least > 1 and share < 0.5:
                params["minWeightFractionPerNode"] = max(share, params.get("minWeightFractionPerNode", 0.0))
            elif least > 1:  # no split leaves so many on both sides
                params["maxDepth"] = 0
        return kind(featuresCol="_features", labelCol=self.label, **params)

    def draws_rows(self, **more: object) -> bool:
        return self._params(more).get("subsamplingRate", 1.0) < 1.0

    @property
    def keeps_sums(self) -> bool:
        """Whether the loss depends on no more than the number, sum and sum of squares of the labels of rows alike."""
        return self.objective == "regression" and self._params({}).get("lossType", "squared") == "squared"

    def preparation(self, train: DataFrame, trials: Sequence[Mapping] = (), parts: int = 1) -> Preparation:
        """What makes the feature vector, with what it needs counted in ``train``: two passes, a third where columns are many.

        ``trials`` are the parameters the rows are used with, ``parts`` the folds they are told apart by.
        """
        stages: list[Transformer] = []
        labels: dict[str, list[str]] = {}
        if self.codes:
            labels = frequent_values(train, self.codes, self.max_bins - 2)
            stages.append(
                StringIndexerModel.from_arrays_of_labels(
                    [labels[c] for c in self.codes], [f"_text_{c}" for c in self.codes],
                    [f"_code_{c}" for c in self.codes], handleInvalid="keep",
                )
            )
            texts = ", ".join(f"CAST(`{c}` AS STRING) AS `_text_{c}`" for c in self.codes)
            stages.insert(0, SQLTransformer(statement=f"SELECT *, {texts} FROM __THIS__"))
        every = [self._params(t) for t in trials or [{}]]
        bins = max(self.max_bins, *[p["maxBins"] for p in every])
        number = lambda f: F.nullif(F.col(f).cast("double"), F.lit(float("nan")))
        at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        found = train.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.avg(number(f)).alias(f"mean {f}") for f in self.features],
            *[F.count(number(f)).alias(f"known {f}") for f in self.features],
            *[F.approx_count_distinct(number(f), 0.02).alias(f"values {f}") for f in self.features],
            *[F.percentile_approx(number(f), at, 10_000).alias(f"cuts {f}") for f in self.features],
        ).first()
        rows = found["rows"]
        merge = rows > self.merge_above and not any("weightCol" in p or p.get("lossType") not in (None, "squared", "logistic") for p in every)
        gaps = [f for f in self.features if found[f"known {f}"] < rows]
        cuts = {f: sorted(set(found[f"cuts {f}"])) for f in self.features if merge and found[f"values {f}"] > bins}
        sizes = [(len(cuts[f]) + 1 if f in cuts else found[f"values {f}"]) + (f in gaps) for f in self.features]
        cells = prod([*sizes, *[len(v) + 1 for v in labels.values()], parts])
        value = "nullif(CAST(`{}` AS DOUBLE), CAST('NaN' AS DOUBLE))"

        def columns(cut: Mapping[str, list[float]]) -> Preparation:
            made = {}
            for f in self.features:
                name = f"_value_{f}" if f in cut else f"_in_{f}"
                made[name] = f"coalesce({value.format(f)}, {float(found[f'mean {f}'] or 0.0)!r}D)"
                if f in gaps:
                    made[f"_missing_{f}"] = f"CAST({value.format(f)} IS NULL AS DOUBLE)"
            more = list(stages)
            if made:
                more.append(SQLTransformer(statement=f"SELECT *, {', '.join(f'{t} AS `{n}`' for n, t in made.items())} FROM __THIS__"))
            if cut:
                ends = [[float("-inf"), *[c for c in cut[f] if abs(c) != float("inf")], float("inf")] for f in cut]
                more.append(Bucketizer(splitsArray=ends, inputCols=[f"_value_{f}" for f in cut], outputCols=[f"_bin_{f}" for f in cut]))
                plain = ", ".join(f"`_bin_{f}` + 0D AS `_in_{f}`" for f in cut)  # a number to the trees, not a nominal column
                more.append(SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__"))
            inputs = [n for f in self.features for n in (f"_in_{f}", f"_missing_{f}") if n in made or n == f"_in_{f}"]
            return Preparation(more, [*inputs, *[f"_code_{c}" for c in self.codes]])

        if not merge:
            return columns({})
        binned = columns(cuts)
        if 4 * cells > rows:
            there = PipelineModel(list(binned.stages)).transform(train)
            key = F.xxhash64(*binned.inputs, *([] if self.keeps_sums else [self.label]))
            cells = there.agg(F.approx_count_distinct(key, 0.02)).first()[0] * parts
        return Preparation(binned.stages, binned.inputs, max(1, cells)) if 4 * cells <= rows else columns({})

    def rows(self, df: DataFrame, made: Preparation, keep: Sequence[str] = (), drawn: bool = False) -> DataFrame:
        """The columns of the vector, the label and ``keep``: of each row, or of rows alike with their number as weight.

        Merged rows of squared loss are two points, one deviation below and one above the mean of their labels. Their number, sum
        and sum of squares are those of the rows, hence all splits, leaves and errors. Rows of one vector are dealt to
        so many lots that ``LOTS`` merged rows remain, and ``DRAWN_LOTS`` for trees that draw rows (``drawn``): these draw lots.
        """
        rows = PipelineModel(list(made.stages)).transform(df)
        if not made.cells:
            return rows.select(*made.inputs, self.label, *keep)
        lots = -(-(DRAWN_LOTS if drawn else LOTS) // made.cells)
        rows = rows.withColumn("_lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lots)))
        keys = [*made.inputs, *keep, "_lot"]
        if not self.keeps_sums:
            merged = rows.groupBy(*keys, self.label).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
            return merged.select(*made.inputs, self.label, *keep, WEIGHT)
        label, n = F.col(self.label).cast("double"), F.col("_n")
        merged = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.avg(label).alias("_mean"), F.stddev_pop(label).alias("_spread"), F.count(label).alias("_known")
        )
        mean = F.when(F.col("_known") == n, F.col("_mean"))  # a missing label is an error of the learner, as without merging
        point = lambda y, w: F.struct(y.alias(self.label), w.cast("double").alias(WEIGHT))
        two = F.array(point(mean - F.col("_spread"), n / 2), point(mean + F.col("_spread"), n / 2))
        points = F.when(F.col("_spread") > 0, two).otherwise(F.array(point(mean, n)))
        return merged.select(*made.inputs, *keep, F.inline(points))

    def evaluator(self, weighted: bool = False):
        more = {"weightCol": WEIGHT} if weighted else {}
        if self.objective == "binary":
            return BinaryClassificationEvaluator(labelCol=self.label, **more)
        return RegressionEvaluator(labelCol=self.label, metricName="mse", **more)

    @property
    def larger_is_better(self) -> bool:
        return self.objective == "binary"


def frequent_values(df: DataFrame, columns: Sequence[str], most: int) -> dict[str, list[str]]:
    """Up to ``most`` values of each column as texts, the most frequent first, ties in text order; all in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.inline(pairs)).filter("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("c").orderBy(F.desc("n"), "v")
    kept = counts.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= most).orderBy("c", "i").collect()
    return {c: [r["v"] for r in kept if r["c"] == c] for c in columns}


def fit_boosting(train: DataFrame, job: Boosting, valid: DataFrame | None = None) -> PipelineModel:
    """Fit trees; with validation rows, stop when they no longer improve (``UNTIL_WORSE`` leaves the number of rounds to them)."""
    checkpoints(train.sparkSession)  # MLlib cuts the lineage of many rounds there
    made = job.preparation(train)
    mark, rows = {}, train
    if valid is not None:
        mark = {"validationIndicatorCol": "_is_valid"}
        rows = train.withColumn("_is_valid", F.lit(False)).unionByName(valid.withColumn("_is_valid", F.lit(True)))
    if not made.cells and valid is None:
        return Pipeline(stages=[*made.stages, made.assembler(), job.learner()]).fit(rows)
    vectors = made.assembler().transform(job.rows(rows, made, list(mark.values()), job.draws_rows()))
    if valid is not None:
        vectors = vectors.select("_features", job.label, *mark.values(), *([WEIGHT] if made.cells else []))
    vectors = vectors.persist()
    try:
        learned = vectors.filter(~F.col("_is_valid")) if mark else vectors
        weight = learned.agg(F.sum(WEIGHT)).first()[0] if made.cells else None
        few = vectors if valid is None else vectors.coalesce(-(-vectors.count() // ROWS_A_TASK) or 1)
        return PipelineModel([*made.stages, made.assembler(), job.learner(weight, **mark).fit(few)])
    finally:
        vectors.unpersist()


def score(model: PipelineModel, df: DataFrame, name: str = "pred") -> DataFrame:
    """Append the prediction (of class 1, for a binary model)."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))
    return scored.select(*df.columns, F.col("prediction").alias(name))


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance), one row per listed column; a missing flag counts for its column."""
    weights = model.stages[-1].featureImportances.toArray()
    inputs = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    total = dict.fromkeys(features, 0.0)
    for name, weight in zip(inputs, weights):
        total[_source(name)] += float(weight)
    return SparkSession.active().createDataFrame(list(total.items()), "feature string, importance double")


def fit_folds(
    df: DataFrame, job: Boosting, folds: int, group: str, entry: str | Sequence[str],
    fold: str = "fold", mode: str = "argmin", parallelism: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Fit one model per fold; returns the fold scores and their summary. Each model scores its fold once."""

    def one(i: int) -> tuple:
        train, test = fold_frames(df, i, fold)
        report = top1_report(score(fit_boosting(train, job, test), test), group, entry, mode=mode).first()
        return (i, *[report[m] for m in METRICS])

    rows = _in_parallel(one, range(folds), parallelism)
    fields = ", ".join(f"{m} double" for m in METRICS)
    scores = df.sparkSession.createDataFrame(rows, f"fold int, {fields}")
    return scores, fold_summary(scores, METRICS)


def _in_parallel(work: Callable, items: Iterable, parallelism: int) -> list:
    """Results in the order of the items; Spark shares its executors among the jobs of all threads."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))


def fold_metrics(
    df: DataFrame, job: Boosting, trials: Sequence[Mapping], folds: int, fold: str = "fold", parallelism: int = 4
) -> list[float]:
    """Mean validation metric of each parameter set over given folds.

    The feature vectors are made once, merged where rows are alike, kept, and shared by all trials and folds, which run from a
    pool of threads.
    """
    made = job.preparation(df, trials, folds)
    draws = [bool(made.cells) and job.draws_rows(**t) for t in trials]
    prepared = {d: made.assembler().transform(job.rows(df, made, [fold], d)).persist() for d in sorted(set(draws))}
    try:
        parts = {d: [fold_frames(rows, i, fold) for i in range(folds)] for d, rows in prepared.items()}
        weights = [None] * folds
        if made.cells:
            of_fold = {r[0]: r[1] for r in next(iter(prepared.values())).groupBy(fold).agg(F.sum(WEIGHT)).collect()}
            weights = [sum(of_fold.values()) - of_fold.get(i, 0.0) for i in range(folds)]

        def one(place: tuple[int, int]) -> float:
            trial, i = place
            train, test = parts[draws[trial]][i]
            model = job.learner(weights[i], **trials[trial]).fit(train)
            return job.evaluator(bool(made.cells)).evaluate(model.transform(test))

        places = [(t, i) for t in range(len(trials)) for i in range(folds)]
        values = _in_parallel(one, places, parallelism)
    finally:
        for rows in prepared.values():
            rows.unpersist()
    return [sum(values[t * folds : (t + 1) * folds]) / folds for t in range(len(trials))]


def cross_validate(
    df: DataFrame, job: Boosting, folds: int, fold: str = "fold",
    grid: Mapping[str, Sequence] | None = None, parallelism: int = 4,
) -> DataFrame:
    """Mean validation metric of every parameter combination over given folds."""
    names = list(grid or {})
    trials = [dict(zip(names, values)) for values in product(*(grid or {}).values())]
    metrics = fold_metrics(df, job, trials, folds, fold, parallelism)
    rows = [(i, {k: str(v) for k, v in t.items()}, float(m)) for i, (t, m) in enumerate(zip(trials, metrics))]
    return df.sparkSession.createDataFrame(rows, "trial int, params map<string,string>, metric double")


def random_trials(space: Mapping[str, Sequence], trials: int, seed: int = 32) -> list[dict]:
    """Parameter combinations drawn from lists of values."""
    draw = random.Random(seed)
    return [{name: draw.choice(list(values)) for name, values in space.items()} for _ in range(trials)]


def search(
    df: DataFrame, job: Boosting, trials: Sequence[Mapping], folds: int, fold: str = "fold", parallelism: int = 4
) -> DataFrame:
    """Mean fold metric of each listed parameter set, best first."""
    metrics = fold_metrics(df, job, trials, folds, fold, parallelism)
    rows = [(i, str(dict(t)), float(m)) for i, (t, m) in enumerate(zip(trials, metrics))]
    rows.sort(key=lambda r: -r[2] if job.larger_is_better else r[2])
    return df.sparkSession.createDataFrame(rows, "trial int, params string, metric double")


def ablation(train: DataFrame, test: DataFrame, job: Boosting, parallelism: int = 4) -> DataFrame:
    """Refit without each feature: its score, and whether the score is not worse.

    The columns of the vector are made once, merged where rows are alike, and kept; a fit leaves its feature's columns out.
    """
    made = job.preparation(train)
    learned, judged = job.rows(train, made, drawn=job.draws_rows()).persist(), job.rows(test, made).persist()

    def metric(left_out: str | None) -> float:
        vectors = made.assembler(left_out)
        model = job.learner(weight).fit(vectors.transform(learned))
        return job.evaluator(bool(made.cells)).evaluate(model.transform(vectors.transform(judged)))

    columns = [*job.features, *job.codes]
    try:
        weight = learned.agg(F.sum(WEIGHT)).first()[0] if made.cells else None
        full, *values = _in_parallel(metric, [None, *columns], parallelism)
    finally:
        learned.unpersist()
        judged.unpersist()
    rows = []
    for left_out, value in zip(columns, values):
        not_worse = value >= full if job.larger_is_better else value <= full
        rows.append((left_out, float(value), "T" if not_worse else "F"))
    return train.sparkSession.createDataFrame(rows, "feature string, score double, unnecessary string")


def keep_best(
    model: PipelineModel, metric: float, best: float | None, path: str, larger_is_better: bool = True
) -> float:
    """Save the model if its metric beats the best so far; returns the new best."""
    better = best is None or (metric > best if larger_is_better else metric < best)
    if better:
        model.write().overwrite().save(path)
        return metric
    return best
