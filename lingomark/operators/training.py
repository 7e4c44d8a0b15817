"""Scoring models: training, application, persistence, stacking and comparison."""

from __future__ import annotations

from functools import reduce
from operator import and_
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingomark.contracts import EMBEDDING_SIZE, contract_columns, require_columns, scalar_columns
from lingomark.functions.numeric import ensemble_mean
from lingomark.functions.vectors import guard
from lingomark.operators.split import SEED, exact_split
from lingomark.operators.stats import error_metrics
from lingomark.session import stage

# Trees, step size and depth of the boosted regressors, by use.
GBT_PRESETS: dict[str, dict[str, float]] = {
    "embedding": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6},
    "features": {"maxIter": 100, "stepSize": 0.05, "maxDepth": 4},
    "embedding_small": {"maxIter": 100, "stepSize": 0.3, "maxDepth": 5},
    "hybrid_plain": {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6},
    "hybrid": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6},
}
FOREST_TREES = 10

# Feature values of a training task.
CELLS_PER_TASK = 1 << 20

# Working column of an embedding among the features.
VECTOR = "_embedding"


@dataclass(frozen=True)
class Scorer:
    """A fitted model with the feature contract it was trained on.

    ``columns`` are its numeric columns in their order. Contracts with an embedding have it behind them
    as one array column, ``vector``, of ``size`` values.
    """

    contract: str
    columns: tuple[str, ...]
    model: PipelineModel
    vector: str | None = None
    size: int = 0


def gbt(preset: str = "embedding", **changes) -> GBTRegressor:
    """Boosted trees with the reference settings; ``changes`` override single parameters."""
    return GBTRegressor(
        labelCol="label", featuresCol="features", seed=SEED, **{**GBT_PRESETS[preset], **changes}
    )


def forest(**changes) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol="label", featuresCol="features", seed=SEED, **{"numTrees": FOREST_TREES, **changes}
    )


def compact(df: DataFrame, width: int, cells: int = CELLS_PER_TASK) -> DataFrame:
    """The rows in as many partitions as their number and ``width`` ask for, written.

    Boosting runs several small jobs per tree over one input, so its tasks should be neither many nor large.
    """
    rows = stage(df, "training")
    parts = max(1, -(-rows.count() * width // cells))
    return rows.coalesce(parts)


def _inputs(columns: Sequence[str], vector: str | None, size: int) -> list[Column]:
    """The features of a row: numbers as doubles, the array as a vector of its declared size."""
    plain = [F.col(c).cast("double").alias(c) for c in columns]
    return plain if vector is None else [*plain, array_to_vector(guard(F.col(vector), size)).alias(VECTOR)]


def _usable(columns: Sequence[str], vector: str | None, size: int) -> Column:
    """Whether a row has every feature: no NULL, no NaN, an array of the declared size."""
    checks = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    if vector is not None:
        whole = (F.array_size(vector) == size) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
        checks.append(F.coalesce(whole, F.lit(False)))
    return reduce(and_, checks)


def fit_scorer(
    df: DataFrame,
    contract: str,
    regressor,
    columns: Sequence[str] | None = None,
    vector: str | None = None,
    size: int = EMBEDDING_SIZE,
) -> Scorer:
    """Fit on the contract's columns in the contract's order; ``label`` is the target.

    With ``vector`` the embedding of a contract stays one array column, which joins the others in the
    assembler, instead of ``size`` scalar columns. A row without a feature or label is an error: drop
    or fill such rows before.
    """
    if columns is None:
        columns = contract_columns(contract) if vector is None else scalar_columns(contract)
    ordered = tuple(columns)
    require_columns(df, [*ordered, *([] if vector is None else [vector]), "label"])
    inputs = [*ordered] if vector is None else [*ordered, VECTOR]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    hint = [] if vector is None else [VectorSizeHint(inputCol=VECTOR, size=size, handleInvalid="optimistic")]
    target = F.col("label").cast("double").alias("label")
    whole = _usable(ordered, vector, size) & target.isNotNull()
    refused = F.raise_error(F.lit("A training row lacks a feature or its label"))
    train = df.select(*_inputs(ordered, vector, size), F.when(whole, target).otherwise(refused.cast("double")).alias("label"))
    model = Pipeline(stages=[*hint, assembler, regressor]).fit(train)
    return Scorer(contract, ordered, model, vector, 0 if vector is None else size)


def apply_scorer(df: DataFrame, scorer: Scorer, output: str = "prediction") -> DataFrame:
    """Predict for the whole table; a missing feature column is an error.

    Rows with a NULL or NaN feature, or an array of another size, get a NULL score and do not stop the
    others. The caller's own columns are kept, whatever the model calls its working columns; one named
    ``output`` is replaced.
    """
    require_columns(df, [*scorer.columns, *([] if scorer.vector is None else [scorer.vector])])
    kept = [c for c in df.columns if c != output]
    *hint, assembler, regressor = scorer.model.stages
    model = PipelineModel([*hint, assembler.copy().setHandleInvalid("keep"), regressor])
    usable = _usable(scorer.columns, scorer.vector, scorer.size)
    rows = df.select(
        F.struct(*kept).alias("_row"), usable.alias("_usable"), *_inputs(scorer.columns, scorer.vector, scorer.size)
    )
    scored = model.transform(rows)
    return scored.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.when(F.col("_usable"), F.col("prediction")).alias(output))


def fit_vectors(df: DataFrame, vector: str, regressor) -> PipelineModel:
    """Fit on an array column directly, without widening it."""
    train = df.select(array_to_vector(vector).alias("features"), F.col("label").cast("double"))
    return Pipeline(stages=[regressor]).fit(train)


def apply_vectors(df: DataFrame, vector: str, model: PipelineModel, output: str = "prediction") -> DataFrame:
    """Like :func:`apply_scorer` for a model of :func:`fit_vectors`: NULL where the array is not usable."""
    size = model.stages[-1].numFeatures
    kept = [c for c in df.columns if c != output]
    rows = df.select(
        F.struct(*kept).alias("_row"),
        _usable((), vector, size).alias("_usable"),
        array_to_vector(guard(F.col(vector), size)).alias("features"),
    )
    scored = model.transform(rows)
    return scored.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.when(F.col("_usable"), F.col("prediction")).alias(output))


CONTRACT_TYPE = "contract string, columns array<string>, vector string, size int"


def save_scorer(scorer: Scorer, path: str) -> None:
    """Save the model and, next to it, its contract with the column order."""
    scorer.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    record = spark.createDataFrame([(scorer.contract, list(scorer.columns), scorer.vector, scorer.size)], CONTRACT_TYPE)
    record.write.mode("overwrite").json(f"{path}/contract")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    record = spark.read.schema(CONTRACT_TYPE).json(f"{path}/contract").first()
    model = PipelineModel.load(f"{path}/model")
    return Scorer(record["contract"], tuple(record["columns"]), model, record["vector"], record["size"] or 0)


def train_and_evaluate(
    df: DataFrame,
    key: str,
    contract: str,
    regressor,
    share: float = 0.15,
    columns: Sequence[str] | None = None,
) -> tuple[Scorer, DataFrame]:
    """Exact split, fit on the training part, metrics of both parts (one row per part).

    ``df`` is read several times; stage it when it is expensive.
    """
    parts = exact_split(df, key, share)
    scorer = fit_scorer(parts.where(F.col("split") == "train"), contract, regressor, columns)
    metrics = error_metrics(apply_scorer(parts, scorer), "label", "prediction", by=["split"])
    return scorer, metrics


def stacked_score(
    df: DataFrame, first: Scorer, second: Scorer, output: str = "grammar_score", second_output: str = "second_score"
) -> DataFrame:
    """The first score becomes feature ``grammar_score_model`` of the second; both are kept, and averaged."""
    base = apply_scorer(df, first, "grammar_score_model")
    stacked = apply_scorer(base, second, second_output)
    return stacked.withColumn(output, ensemble_mean(F.col("grammar_score_model"), F.col(second_output)))


def compare_scores(df: DataFrame, key: str, first: Column, second: Column) -> DataFrame:
    """Two scores side by side with their difference."""
    return df.select(
        key, first.alias("first_score"), second.alias("second_score"), (second - first).alias("difference")
    )


def probe_contracts(
    spark: SparkSession, scorer: Scorer, samples: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """Try one sample row per contract against a model: ``contract, ok, error``."""
    outcome = []
    for contract, sample in samples.items():
        row = spark.createDataFrame(
            [tuple(float(v) for v in sample.values())], ", ".join(f"{c} double" for c in sample)
        )
        try:
            if tuple(sample) != scorer.columns:
                require_columns(row, scorer.columns)
                extra = [c for c in sample if c not in scorer.columns]
                raise ValueError(f"Unexpected or misplaced columns: {extra or list(sample)}")
            apply_scorer(row, scorer).first()
            outcome.append((contract, True, None))
        except Exception as error:
            outcome.append((contract, False, str(error)))
    return spark.createDataFrame(outcome, "contract string, ok boolean, error string")
