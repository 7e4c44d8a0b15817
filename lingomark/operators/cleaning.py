"""Null handling, defaults and row validity policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingomark.contracts import AUDIO_COLUMNS
from lingomark.functions.text import error_text, is_nonblank


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def fill_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and NaN features become 0."""
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return df.withColumns(filled)


def fill_target_mean(df: DataFrame, target: str, known: DataFrame | None = None) -> DataFrame:
    """Missing targets become the mean target.

    The mean is taken over all rows of ``df``, or over ``known`` (for instance the training part)
    when given. It reaches the rows as a scalar subquery, not through a join.
    """
    source = df if known is None else known
    clean = F.when(~F.isnan(F.col(target).cast("double")), F.col(target))
    mean = source.select(clean.alias("y")).agg(F.avg("y")).scalar()
    return df.withColumn(target, F.coalesce(clean.cast("double"), mean))


def default_audio(df: DataFrame, columns: Sequence[str] = AUDIO_COLUMNS) -> DataFrame:
    """Audio features of rows without usable audio become 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def nonblank_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_nonblank(F.col(column)))


def drop_failed(df: DataFrame, error: str = "error") -> DataFrame:
    """Policy "drop": rows with an error leave the table."""
    return df.where(F.col(error).isNull())


def failed_lines(df: DataFrame, key: str, error: str = "error") -> DataFrame:
    """The rows :func:`drop_failed` removes, one text line each, for the error log."""
    failed = df.where(F.col(error).isNotNull())
    return failed.select(F.concat_ws(": ", F.col(key).cast("string"), F.col(error)).alias("value"))


def keep_failed(
    df: DataFrame, texts: Sequence[str], score: str | None = None, error: str = "error"
) -> DataFrame:
    """Policy "keep": failed rows carry ``Error: <message>`` as text and score 0."""
    failed = F.col(error).isNotNull()
    changed = {c: F.when(failed, error_text(F.col(error))).otherwise(F.col(c)) for c in texts}
    if score is not None:
        changed[score] = F.when(failed, F.lit(0.0)).otherwise(F.col(score))
    return df.withColumns(changed)


def require_rows(df: DataFrame, message: str = "No features were successfully extracted") -> DataFrame:
    """Fail when nothing survived."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def union_outcomes(succeeded: DataFrame, failed: DataFrame) -> DataFrame:
    """Bag union by column name; a column one side lacks is NULL there."""
    return succeeded.unionByName(failed, allowMissingColumns=True)
