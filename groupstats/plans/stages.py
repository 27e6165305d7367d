"""Named, cached stages, and operators that are fitted once, applied often and saved."""

from __future__ import annotations

import dataclasses
import hashlib
import inspect
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from groupstats.operators.encode import TargetMeans
from groupstats.skew import Fitted

Stage = Callable[..., DataFrame] | Transformer | Estimator

# ------------------------------------------------------------- fit and apply


@dataclass(frozen=True)
class Operator:
    """The halves of a fitted operator: ``fit(df, **params)`` gives a state, ``apply(df, state, **params)`` uses it."""

    fit: Callable[..., Any]
    apply: Callable[..., DataFrame]


#: Operators by the name under which stages are saved.
OPERATORS: dict[str, Operator] = {}


class _Saved(MLWritable, MLReadable):
    """Stages that are an operator's name, its parameters and a state."""

    operator: str
    params_: dict[str, Any]
    refit: bool
    state: Any = None

    def write(self) -> MLWriter:
        return _StageWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StageReader(cls)


class FittedStage(Model, _Saved):
    """Applies its operator with the state found by a :class:`FitStage`."""

    def __init__(self, operator: str, params: Mapping[str, Any], refit: bool, state: Any):
        super().__init__()
        self.operator, self.params_, self.refit, self.state = operator, dict(params), refit, state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        halves = OPERATORS[self.operator]
        state = halves.fit(dataset, **self.params_) if self.refit else self.state
        return halves.apply(dataset, state, **self.params_)


class FitStage(Estimator, _Saved):
    """An operator with a fit and an apply half.

    ``fit`` computes statistics from the training rows; the model applies them
    to any rows. With ``refit=True`` the model computes them anew from the rows
    it is given. Parameters are what JSON can hold, so that stages and models are saved by ``save`` and read by ``load``.
    """

    def __init__(self, operator: str, params: Mapping[str, Any], refit: bool = False):
        super().__init__()
        self.operator, self.params_, self.refit = operator, dict(params), refit

    def _fit(self, dataset: DataFrame) -> FittedStage:
        state = None if self.refit else OPERATORS[self.operator].fit(dataset, **self.params_)
        return FittedStage(self.operator, self.params_, self.refit, state)


def _encode(value: Any, tables: list[DataFrame]) -> Any:
    """A state as JSON; tables are put aside and named by their number."""
    if isinstance(value, (Fitted, TargetMeans)):
        parts = {f.name: _encode(getattr(value, f.name), tables) for f in dataclasses.fields(value)}
        return {"is": type(value).__name__, **parts}
    if isinstance(value, DataFrame):
        tables.append(value)
        return {"is": "table", "number": len(tables) - 1}
    if isinstance(value, Mapping):
        return {"is": "dict", "items": [[k, _encode(v, tables)] for k, v in value.items()]}
    if isinstance(value, tuple):
        return {"is": "tuple", "items": [_encode(v, tables) for v in value]}
    return value


def _decode(value: Any, table: Callable[[int], DataFrame]) -> Any:
    if not isinstance(value, dict):
        return value
    kind = value["is"]
    if kind == "table":
        return table(value["number"])
    if kind == "dict":
        return {k: _decode(v, table) for k, v in value["items"]}
    if kind == "tuple":
        return tuple(_decode(v, table) for v in value["items"])
    made = {"Fitted": Fitted, "TargetMeans": TargetMeans}[kind]
    return made(**{k: _decode(v, table) for k, v in value.items() if k != "is"})


class _StageWriter(MLWriter):
    def __init__(self, stage: _Saved):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:  # noqa: N802
        tables: list[DataFrame] = []
        more = {
            "operator": self.stage.operator, "parameters": self.stage.params_, "refit": self.stage.refit,
            "state": _encode(self.stage.state, tables),
        }
        DefaultParamsWriter.saveMetadata(self.stage, path, SparkSession.active(), extraMetadata=more)
        for number, table in enumerate(tables):
            table.write.mode("overwrite").parquet(f"{path}/table-{number}")


class _StageReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Any:
        spark = SparkSession.active()
        found = DefaultParamsReader.loadMetadata(path, spark)
        args = [found["operator"], found["parameters"], found["refit"]]
        if issubclass(self.kind, FittedStage):
            args.append(_decode(found["state"], lambda n: spark.read.parquet(f"{path}/table-{n}")))
        stage = self.kind(*args)
        stage._resetUid(found["uid"])
        return stage


# --------------------------------------------------------------- staged runs


def fingerprint(value: Any) -> str:
    """A digest of a parameter, a stage or a table: of its plan and the names, sizes and times of its files."""
    return hashlib.sha256(json.dumps(_described(value), sort_keys=True).encode()).hexdigest()


def _described(value: Any) -> Any:
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, DataFrame):
        return ["table", value.semanticHash(), value.schema.json(), _files(value)]
    if isinstance(value, _Saved):
        return ["stage", type(value).__name__, value.operator, _described(value.params_), value.refit, _described(value.state)]
    if isinstance(value, (Transformer, Estimator)):
        settings = {p.name: str(v) for p, v in value.extractParamMap().items()}
        return ["stage", type(value).__qualname__, settings]
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return [type(value).__name__, {f.name: _described(getattr(value, f.name)) for f in dataclasses.fields(value)}]
    if isinstance(value, Mapping):
        return ["dict", [[str(k), _described(v)] for k, v in value.items()]]
    if isinstance(value, (list, tuple, set, frozenset)):
        parts = [_described(v) for v in value]
        return ["set", sorted(map(repr, parts))] if isinstance(value, (set, frozenset)) else ["list", parts]
    if callable(value):
        code = getattr(inspect.unwrap(value), "__code__", None)
        held = inspect.getclosurevars(value).nonlocals if code is not None else {}
        # what a closure holds counts if it is data
        data = {k: v for k, v in held.items() if isinstance(v, (bool, int, float, str, tuple, Mapping))}
        return ["code", getattr(value, "__qualname__", repr(type(value))), code and [code.co_code.hex(), repr(code.co_names), [str(c) for c in code.co_consts if isinstance(c, (int, float, str))]], _described(data)]
    return repr(value)


def _files(df: DataFrame) -> list[list]:
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append([name, status.getLen(), status.getModificationTime()])
    return found


@dataclass
class StagedRun:
    """Stages run in the order added; each result is kept as a Parquet table.

    A table is named by its stage and a fingerprint of the stage, its parameters and all that came before it, the input's
    plan and files included. A stage whose table is already complete under ``folder`` is read instead of run, so a run
    resumes after a failure, and reading cuts the lineage; a changed parameter, stage or input runs it and all later ones again.
    Models of fitted stages are saved beside the tables, so :meth:`apply` works in another session too.
    """

    folder: str
    stages: list[tuple[str, Stage, Mapping[str, Any], bool]] = field(default_factory=list)
    models: dict[str, Transformer] = field(default_factory=dict)

    def add(self, stage: Stage, params: Mapping[str, Any] | None = None, name: str | None = None, keep: bool = True) -> StagedRun:
        name = name or getattr(stage, "__name__", type(stage).__name__)
        if any(name == n for n, *_ in self.stages):
            raise ValueError(f"stage {name} is already there")
        self.stages.append((name, stage, dict(params or {}), keep))
        return self

    def fit_gene(self, df: DataFrame) -> DataFrame:
        """Run all stages, fitting those that are fitted."""
        so_far = fingerprint(df)
        for name, stage, params, keep in self.stages:
            so_far = fingerprint([so_far, name, stage, params])
            path = f"{self.folder}/{name}-{so_far[:16]}"
            saved = isinstance(stage, FitStage)
            if keep and (saved or not isinstance(stage, Estimator)) and _complete(df, path):
                if saved:
                    self.models[name] = FittedStage.load(f"{path}-model")
                df = df.sparkSession.read.parquet(path)
                continue
            df = self._run(name, stage, params, df)
            if keep:
                if saved:  # first, so that a complete table has its model
                    self.models[name].write().overwrite().save(f"{path}-model")
                df.write.mode("overwrite").parquet(path)
                df = df.sparkSession.read.parquet(path)
        return df

    def apply(self, df: DataFrame) -> DataFrame:
        """Run all stages on new rows with the models of the last fit."""
        for name, stage, params, _ in self.stages:
            if isinstance(stage, Estimator):
                df = self.models[name].transform(df)
            else:
                df = self._run(name, stage, params, df)
        return df

    def _run(self, name: str, stage: Stage, params: Mapping[str, Any], df: DataFrame) -> DataFrame:
        if isinstance(stage, Estimator):
            self.models[name] = stage.fit(df)
            return self.models[name].transform(df)
        if isinstance(stage, Transformer):
            return stage.transform(df)
        return stage(df, **params)


def _complete(df: DataFrame, path: str) -> bool:
    """Whether a finished table lies at ``path``, on any file system Spark writes."""
    spark = df.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
