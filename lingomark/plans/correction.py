"""The correction cascade: chunk, correct, rule pass, join, rule pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingomark.functions.text import (
    CHUNK_LIMIT,
    Rule,
    apply_rules,
    correction_units,
    join_chunks,
    let,
    substitute_words,
)
from lingomark.operators.apply_model import Predictor, apply_model, apply_model_to_units
from lingomark.operators.resolve import join_content
from lingomark.session import stage


def cascade(
    text: Column,
    model: Callable[[Column], Column] = substitute_words,
    rules: Sequence[Rule] = (),
    limit: int = CHUNK_LIMIT,
    original_when_single: bool = True,
) -> Column:
    """Correct a text with a native model.

    Every unit passes the model and then the rules; several units are joined and pass the rules
    once more. Runs inside one projection, without a shuffle.
    """

    def finish(units: Column) -> Column:
        several = join_chunks(F.transform(units, lambda u: apply_rules(model(u), rules)))
        single = apply_rules(model(F.element_at(units, 1)), rules)
        return F.when(F.array_size(units) == 1, single).otherwise(apply_rules(several, rules))

    return let(correction_units(text, limit, original_when_single), finish)


def _finish_units(values: Column, rules: Sequence[Rule]) -> Column:
    """Rules over each corrected unit; several units are joined and pass the rules once more."""
    done = F.transform(values, lambda u: apply_rules(u, rules))
    return F.when(F.array_size(done) == 1, F.element_at(done, 1)).otherwise(apply_rules(join_chunks(done), rules))


def cascade_with_predictor(
    df: DataFrame,
    text: str,
    load: Callable[[], Predictor],
    rules: Sequence[Rule] = (),
    output: str = "corrected_text",
    limit: int = CHUNK_LIMIT,
    original_when_single: bool = True,
    error: str | None = None,
) -> DataFrame:
    """Correct a text with a Python predictor, row by row, so that it also runs on streams.

    The units of a row travel as one array, so the texts are not exploded and regrouped. A row
    whose correction failed keeps its original text; ``error`` names a column for the reason.
    """
    units = df.withColumn("_units", correction_units(F.col(text), limit, original_when_single))
    # Naming the units twice keeps them in a projection of their own, below the Python step.
    answer = F.when(F.col("_units").isNotNull(), apply_model_to_units(F.col("_units"), load))
    answered = units.withColumn("_answer", answer).drop("_units")
    joined = _finish_units(F.col("_answer.value"), rules)
    done = answered.withColumn(output, F.coalesce(joined, F.col(text)))
    if error is not None:
        done = done.withColumn(error, F.col("_answer.error"))
    return done.drop("_answer")


def cascade_distinct(
    df: DataFrame,
    text: str,
    load: Callable[[], Predictor],
    rules: Sequence[Rule] = (),
    output: str = "corrected_text",
    limit: int = CHUNK_LIMIT,
    original_when_single: bool = True,
    error: str | None = None,
) -> DataFrame:
    """:func:`cascade_with_predictor` for tables: the model sees every distinct unit once.

    Distinct texts are cut into units, distinct units are corrected, and the answers go back by the
    SHA-256 of the unit, then of the text. A unit or text that holds a large share of all rows is
    spread over the tasks of both joins. The results of the model are written, so that a lost executor
    does not call it again. NULL texts stay NULL. ``df`` is read several times and its rows are numbered
    on the way: stage it unless it is a scan.
    """
    digest = lambda column: F.unhex(F.sha2(column, 256))
    own = "_text_key"
    names = [c for c in df.columns if c not in (output, error)]
    keyed = df.select(F.struct(*names).alias("_row"), digest(F.col(text)).alias(own), F.monotonically_increasing_id().alias("_place"))
    texts = df.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    cut = texts.select(digest(F.col("text")).alias(own), correction_units(F.col("text"), limit, original_when_single).alias("units"))
    units = stage(
        cut.select(own, F.posexplode("units").alias("at", "unit")).withColumn("unit_key", digest(F.col("unit"))), "units"
    )
    asked = units.select("unit_key", "unit").distinct()
    answers = stage(
        asked.select("unit_key", apply_model(F.col("unit"), load).alias("answer")), "corrections"
    )
    found = join_content(units.select(own, "at", "unit_key"), answers, "unit_key", [own, "at"])
    cells = F.array_sort(F.collect_list(F.struct("at", "answer")))
    gathered = found.groupBy(own).agg(cells.alias("cells"))
    values = F.transform("cells", lambda c: c["answer"]["value"])
    errors = F.filter(F.transform("cells", lambda c: c["answer"]["error"]), lambda e: e.isNotNull())
    fixed = gathered.select(own, values.alias("values"), F.get(errors, F.lit(0)).alias("_error")).select(
        own, "_error", F.when(F.col("_error").isNull(), _finish_units(F.col("values"), rules)).alias("_fixed")
    )
    fixed = stage(fixed, "corrected")
    done = join_content(keyed, fixed, own, ["_place"])
    columns = [F.col(f"_row.`{c}`").alias(c) for c in names]
    columns.append(F.coalesce("_fixed", F.col(f"_row.`{text}`")).alias(output))
    if error is not None:
        columns.append(F.col("_error").alias(error))
    return done.select(*columns)


def corrected(
    df: DataFrame,
    text: str,
    corrector: Callable[[Column], Column] = cascade,
    load_corrector: Callable[[], Predictor] | None = None,
    rules: Sequence[Rule] = (),
    output: str = "corrected_text",
    error: str | None = None,
) -> DataFrame:
    """Add the corrected text: by a Python model if one is given, else by a native expression.

    A text that cannot be corrected stays as it is; ``error`` names a column for the reason. Streams
    correct row by row, tables every distinct unit once.
    """
    if load_corrector is None:
        done = df.withColumn(output, F.coalesce(corrector(F.col(text)), F.col(text)))
        return done if error is None else done.withColumn(error, F.lit(None).cast("string"))
    correct = cascade_with_predictor if df.isStreaming else cascade_distinct
    return correct(df, text, load_corrector, rules, output, error=error)
