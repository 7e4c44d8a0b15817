"""Distributed model application: user predictors over columns, with errors kept per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predictor = Callable[[Sequence[Any]], Sequence[Any]]


class ModelFailed(RuntimeError):
    """A model that answers too few of its inputs: the job ends instead of filling a table with errors."""

# How often a row that ran out of memory is tried again, and the batch size.
MAX_RETRIES = 3
BATCH_SIZE = 8

# A model is judged after this many inputs of a task, and is dead when it failed on all of them.
JUDGED_AFTER = 64
MAX_FAILED = 1.0


def _out_of_memory(error: BaseException) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error)


def predict_guarded(predict: Predictor, items: Sequence[Any], retries: int = MAX_RETRIES) -> list[tuple]:
    """``(value, error)`` per item.

    A failing batch is halved until the failing items stand alone, so its other items still get
    their prediction; a lone item that runs out of memory is tried ``retries`` more times.
    """
    try:
        values = list(predict(items))
        if len(values) != len(items):
            raise ValueError(f"predictor returned {len(values)} results for {len(items)} inputs")
        return [(value, None) for value in values]
    except Exception as error:  # the error becomes data; the task must go on
        if len(items) > 1:
            half = len(items) // 2
            return predict_guarded(predict, items[:half], retries) + predict_guarded(
                predict, items[half:], retries
            )
        if _out_of_memory(error) and retries > 0:
            return predict_guarded(predict, items, retries - 1)
        return [(None, str(error) or type(error).__name__)]


class Budget:
    """Counts a task's inputs and failures, and ends the task when too large a share has failed."""

    def __init__(self, max_failed: float):
        self.max_failed, self.asked, self.failed = max_failed, 0, 0

    def count(self, done: list[tuple]) -> None:
        errors = [error for _, error in done if error is not None]
        self.asked += len(done)
        self.failed += len(errors)
        if self.asked >= JUDGED_AFTER and errors and self.failed >= self.max_failed * self.asked:
            raise ModelFailed(f"the model failed on {self.failed} of {self.asked} inputs of a task, last: {errors[-1]}")


def _batches(predict: Predictor, items: Sequence[Any], size: int, retries: int, budget: Budget) -> list[tuple]:
    done: list[tuple] = []
    for start in range(0, len(items), size):
        found = predict_guarded(predict, items[start : start + size], retries)
        budget.count(found)
        done += found
    return done


def apply_model(
    value: Column,
    load: Callable[[], Predictor],
    result_type: str = "string",
    batch_size: int = BATCH_SIZE,
    retries: int = MAX_RETRIES,
    max_failed: float = MAX_FAILED,
) -> Column:
    """Struct ``(value, error)`` of a predictor over a column; NULL inputs stay NULL.

    ``load`` runs once per Python worker and task; if it fails, the job does. So does a job whose model
    fails on ``max_failed`` of a task's inputs or more, once a task has asked it ``JUDGED_AFTER`` times.
    Only ``value`` crosses to Python; all other
    columns stay in the JVM. The call is marked non-deterministic so that the optimizer neither
    repeats it for a filter nor merges it into several places.
    """

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict, budget = load(), Budget(max_failed)
        for column in series:
            present = column[column.notna()]
            done = _batches(predict, present.tolist(), batch_size, retries, budget)
            out = pd.DataFrame({"value": None, "error": None}, index=column.index, dtype=object)
            out.loc[present.index, "value"] = pd.Series([v for v, _ in done], present.index, dtype=object)
            out.loc[present.index, "error"] = pd.Series([e for _, e in done], present.index, dtype=object)
            yield out

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, returnType=f"value {result_type}, error string").asNondeterministic()
    return udf(value)


def apply_model_to_units(
    units: Column,
    load: Callable[[], Predictor],
    batch_size: int = BATCH_SIZE,
    retries: int = MAX_RETRIES,
    max_failed: float = MAX_FAILED,
) -> Column:
    """Like :func:`apply_model` for an array of texts per row: struct ``(value array, error)``.

    Units of neighbouring rows share batches; results go back to their row in order, without an
    explode and a regrouping shuffle. One failed unit fails its row.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict, budget = load(), Budget(max_failed)
        for rows in batches:
            # Lengths and values of the list column; a NULL row counts as no units.
            lengths = pc.fill_null(pc.list_value_length(rows), 0).to_pylist()
            done = _batches(predict, rows.flatten().to_pylist(), batch_size, retries, budget)
            values, errors, at = [], [], 0
            for length, present in zip(lengths, rows.is_valid().to_pylist()):
                results = done[at : at + length]
                at += length
                failed = next((e for _, e in results if e is not None), None)
                values.append([v for v, _ in results] if present and failed is None else None)
                errors.append(failed)
            yield pa.StructArray.from_arrays(
                [pa.array(values, pa.list_(pa.string())), pa.array(errors, pa.string())], ["value", "error"]
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, returnType="value array<string>, error string").asNondeterministic()
    return udf(units)


def require_success(df: DataFrame, error: str, max_failed: float = MAX_FAILED) -> DataFrame:
    """The table, unless too large a share of it has failed.

    Tasks judge a model by their own inputs; small ones may never ask it often enough. This judges the
    whole result, in one aggregation over a column of it: stage the table before.
    """
    asked, failed = df.agg(F.count(F.lit(1)), F.count(error)).first()
    if asked >= JUDGED_AFTER and failed and failed >= max_failed * asked:
        raise ModelFailed(f"{failed} of {asked} rows failed")
    return df
