"""Predictors that load a model once in each Python worker and read paths in batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# models of this worker by the predictor that loaded them
_LOADED: dict[str, Any] = {}


def worker_model(token: str, load: Callable[[], Any]) -> Any:
    """The model of a predictor; loaded when this worker first needs it, kept for later tasks."""
    if token not in _LOADED:
        _LOADED[token] = load()
    return _LOADED[token]


def room_of(found: Any) -> str | None:
    """A prediction's `label`, else its text."""
    return None if found is None else str(getattr(found, "label", found))


def blur_of(found: Any) -> bool:
    """A prediction's `is_blurry`, else False; a plain boolean counts as such."""
    return found if isinstance(found, bool) else bool(getattr(found, "is_blurry", False))


def _predictor(load: Callable[[], Any], predict: Callable[[Any, list], Iterable],
               kind: str, value: Callable[[Any], Any]) -> Callable[[Column], Column]:
    token = uuid.uuid4().hex

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = worker_model(token, load)
        for paths in batches:
            found = [value(x) for x in predict(model, paths.tolist())]
            if len(found) != len(paths):
                raise ValueError(f"{len(paths)} paths, {len(found)} predictions")
            yield pd.Series(found, dtype=object)

    return run


def room_predictor(load: Callable[[], Any],
                   predict: Callable[[Any, list], Iterable]) -> Callable[[Column], Column]:
    """A predictor for `evaluation.room_pairs`: `predict(model, paths)` gives one result a path.

    A result is a room or has one as `label`. The batches are those of
    spark.sql.execution.arrow.maxRecordsPerBatch.
    """
    return _predictor(load, predict, "string", room_of)


def blur_detector(load: Callable[[], Any],
                  predict: Callable[[Any, list], Iterable]) -> Callable[[Column], Column]:
    """A detector for `evaluation.blur_pairs`; a result is a boolean or has one as `is_blurry`."""
    return _predictor(load, predict, "boolean", blur_of)
