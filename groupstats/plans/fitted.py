"""Operators with a fit and an apply half, as ML stages that can be saved."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from groupstats.functions import fixed
from groupstats.operators import encode, nulls, scaling
from groupstats.plans.stages import OPERATORS, FitStage, Operator


def _operator(name: str, fit: Callable, apply: Callable) -> str:
    OPERATORS[name] = Operator(fit, apply)
    return name


_FILL = _operator(
    "global_fill",
    lambda df, numbers, codes, code_fill: nulls.column_means(df, numbers),
    lambda df, means, numbers, codes, code_fill: nulls.fill_global(df, numbers, codes, code_fill, means),
)
_SCALE = _operator(
    "global_scale",
    lambda df, columns, floor: scaling.fit_moments(df, columns),
    lambda df, moments, columns, floor: scaling.standardize(df, columns, floor, moments),
)
_MEANS = _operator(
    "target_means",
    lambda df, key, target, name, smoothing: encode.fit_target_means(df, key, [target]),
    lambda df, fitted, key, target, name, smoothing: encode.target_encode(
        df, key, target, name, fitted=fitted, unseen="prior", **smoothing
    ),
)
_RARE = _operator(
    "rare_fold",
    lambda df, columns, keep_above: encode.fit_frequent(df, columns, keep_above + 1),
    lambda df, frequent, columns, keep_above: encode.fold_others(df, columns, keep_above=keep_above, frequent=frequent),
)
_LABELS = _operator(
    "labels",
    lambda df, columns: encode.fit_labels(df, columns),
    lambda df, fitted, columns: encode.label_encode(df, columns, fitted),
)


def global_fill(numbers: Sequence[str], codes: Sequence[str] = (), code_fill: str = "nan", refit: bool = False) -> FitStage:
    return FitStage(_FILL, {"numbers": list(numbers), "codes": list(codes), "code_fill": code_fill}, refit)


def global_scale(columns: Sequence[str], floor: float = fixed.STD_FLOOR, refit: bool = False) -> FitStage:
    return FitStage(_SCALE, {"columns": list(columns), "floor": floor}, refit)


def target_means(key: str, target: str, name: str | None = None, refit: bool = False, **smoothing) -> FitStage:
    """Unknown keys get the overall mean of the training rows."""
    return FitStage(_MEANS, {"key": key, "target": target, "name": name, "smoothing": smoothing}, refit)


def rare_fold(columns: Sequence[str], keep_above: int = fixed.KEEP_ABOVE, refit: bool = False) -> FitStage:
    return FitStage(_RARE, {"columns": list(columns), "keep_above": keep_above}, refit)


def labels(columns: Sequence[str], refit: bool = False) -> FitStage:
    return FitStage(_LABELS, {"columns": list(columns)}, refit)
