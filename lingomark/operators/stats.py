"""Column summaries, score metrics, progress counts and pooled vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingomark.functions.numeric import mse_term
from lingomark.operators.ordering import with_row_index

QUARTILES = (0.25, 0.5, 0.75)

# Size of a quantile sketch (its ranks err by some 0.3 %), the ranks it is asked for, how many of them a
# bracket reaches to either side, and the values in a bracket that are told one by one.
SKETCH_SIZE = 800
GRID = 256
REACH = 3
FEW = 1 << 17


def _value(column: str) -> Column:
    """The column as a double, NULL where it is NaN."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _between(value: Column, low: float | None, high: float | None) -> Column:
    inside = value.isNotNull()
    inside = inside if low is None else inside & (value >= low)
    return inside if high is None else inside & (value <= high)


def _grid(value: Column) -> Column:
    """About the quantiles at 0, 1/GRID, ..., 1, from a mergeable sketch; NULL without values."""
    sketch = F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE))
    ranks = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, ranks))


def _bracket(grid: Sequence[float], least: float, most: float) -> tuple[float | None, float | None]:
    """Values around the ranks ``least`` to ``most`` (shares); open at the ends of the sketch."""
    low, high = math.floor(least * GRID) - REACH, math.ceil(most * GRID) + REACH
    return None if low <= 0 else grid[low], None if high >= GRID else grid[high]


def _value_ranks(df: DataFrame, brackets: dict[int, tuple], ranks: dict[int, tuple[int, int]]) -> dict[int, dict[int, float]]:
    """The values at given ranks inside brackets of few values: number -> rank -> value."""
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.when(_between(_value(c), low, high), _value(c)).alias("value"))
            for k, (c, low, high) in brackets.items()
        ]
    )
    inside = df.select(F.inline(F.filter(cells, lambda cell: cell["value"].isNotNull())))
    counted = inside.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    # A bracket has few values, by its count or by the number of different ones.
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("value"))
    steps = counted.withColumn("upto", upto)
    asked = [(k, rank) for k, pair in ranks.items() for rank in set(pair)]
    wanted = F.lit(False)
    for k, rank in asked:
        wanted = wanted | ((F.col("k") == k) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    found: dict[int, dict[int, float]] = {}
    for row in steps.where(wanted).collect():  # at most two rows per quantile
        for k, rank in asked:
            if row["k"] == k and row["upto"] - row["n"] <= rank < row["upto"]:
                found.setdefault(k, {})[rank] = row["value"]
    return found


def _quantiles(df: DataFrame, grids: dict[str, tuple[int, Sequence[float]]], at: Sequence[float]) -> dict[tuple[str, float], float]:
    """Exact quantiles from the counts and grids of the columns.

    A bracket around each wanted rank is taken from the grid and its values are counted; a bracket that
    missed its rank is opened, one that holds too many different values gets a grid of its own. So each
    pass over the table leaves about one value in fifty, and no task holds more than ``FEW``.
    """
    out: dict[tuple[str, float], float] = {}
    open_now: dict[tuple[str, float], tuple] = {}
    ranks: dict[tuple[str, float], tuple[int, int]] = {}
    for c, (n, grid) in grids.items():
        for q in at:
            if n:
                position = (n - 1) * q
                ranks[c, q] = math.floor(position), math.ceil(position)
                open_now[c, q] = _bracket(grid, position / n, (position + 1) / n)
    while open_now:
        keys = list(open_now)
        asked = []
        for k, (c, q) in enumerate(keys):
            value, (low, high) = _value(c), open_now[c, q]
            inside = F.when(_between(value, low, high), value)
            asked += [
                (F.lit(0) if low is None else F.count_if(value < low)).alias(f"below_{k}"),
                F.count(inside).alias(f"inside_{k}"),
                F.approx_count_distinct(inside).alias(f"kinds_{k}"),
            ]
            if grids[c][0] * 4 * REACH // GRID > FEW:
                asked.append(_grid(inside).alias(f"grid_{k}"))
        row = df.agg(*asked).first()
        ready: dict[int, tuple] = {}
        wanted: dict[int, tuple[int, int]] = {}
        for k, (c, q) in enumerate(keys):
            low, high = open_now[c, q]
            below, inside = row[f"below_{k}"], row[f"inside_{k}"]
            first, last = ranks[c, q]
            if first < below or last >= below + inside:
                open_now[c, q] = (None if first < below else low), (None if last >= below + inside else high)
            elif min(inside, row[f"kinds_{k}"]) <= FEW or f"grid_{k}" not in row:
                ready[k], wanted[k] = (c, low, high), (first - below, last - below)
            else:
                inner = _bracket(row[f"grid_{k}"], (first - below) / inside, (last - below + 1) / inside)
                open_now[c, q] = tuple(o if i is None else i for i, o in zip(inner, (low, high)))
        if ready:
            for k, values in _value_ranks(df, ready, wanted).items():
                c, q = keys[k]
                position = (grids[c][0] - 1) * q
                start, end = values[wanted[k][0]], values[wanted[k][1]]
                out[c, q] = start if start == end else start + (end - start) * (position - math.floor(position))
                del open_now[c, q]
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float] = QUARTILES) -> DataFrame:
    """Exact quantiles with linear interpolation: ``column_name, q, value``; none for a column without values.

    ``percentile`` would build one map of all distinct values in one task. The table is read about three
    times, whatever the number of columns and quantiles; stage it when it is expensive. Runs at once.
    """
    row = df.agg(*[F.struct(F.count(_value(c)), _grid(_value(c))).alias(f"c_{k}") for k, c in enumerate(columns)]).first()
    found = _quantiles(df, {c: tuple(row[f"c_{k}"]) for k, c in enumerate(columns)}, at)
    rows = [(c, float(q), found[c, q]) for c in columns for q in at if (c, q) in found]
    return df.sparkSession.createDataFrame(rows, "column_name string, q double, value double")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per numeric column, one row per column.

    A column without values has count 0 and NULLs. The table is read about three times; stage expensive
    features before. Runs at once.
    """
    moments = [F.count, F.avg, F.stddev_samp, F.min, F.max, _grid]
    row = df.agg(
        *[F.struct(*[f(_value(c)).alias(f"m_{i}") for i, f in enumerate(moments)]).alias(f"c_{k}") for k, c in enumerate(columns)]
    ).first()
    found = {c: row[f"c_{k}"] for k, c in enumerate(columns)}
    quartiles = _quantiles(df, {c: (m[0], m[5]) for c, m in found.items()}, QUARTILES)
    rows = [
        (c, m[0], m[1], m[2], m[3], *[quartiles.get((c, q)) for q in QUARTILES], m[4]) for c, m in found.items()
    ]
    names = ["mean double", "std double", "min double", *[f"p{round(q * 100)} double" for q in QUARTILES], "max double"]
    return df.sparkSession.createDataFrame(rows, f"column_name string, count bigint, {', '.join(names)}")


def any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether a column holds a NULL or NaN: ``column_name, has_null``, all columns in one pass."""
    flags = df.agg(
        *[
            F.coalesce(
                F.max(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))), F.lit(False)
            ).alias(c)
            for c in columns
        ]
    )
    return flags.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("has_null")) for c in columns]
            )
        )
    )


def error_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, MSE, MAE and R2 in one aggregation; R2 is NULL when the target does not vary."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    both = df.where(y.isNotNull() & p.isNotNull())
    grouped = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(mse_term(y, p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("_variance"),
    )
    r2 = F.when(F.col("_variance") > 0, 1 - F.col("mse") / F.col("_variance"))
    return grouped.withColumn("r2", r2).drop("_variance")


def progress_counts(df: DataFrame, error: str = "error", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col(error).isNull()).alias("processed"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    )


def hits_by_rule(df: DataFrame, key: str, hits: Column) -> DataFrame:
    """Long table of rule hits: one row per document and rule."""
    return df.select(key, F.inline(hits))


def frame_means(frames: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of a per-frame feature per clip, from a long frame table."""
    return frames.groupBy(key).agg(F.avg(value).alias(value))


def pooled_vectors(df: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """Masked mean vector per key: ``sum(v * mask) / max(sum(mask), 1e-9)``.

    Sums are taken per (key, dimension), partially before the shuffle, so a group of any size
    costs one row per dimension and map task.
    """
    long = df.select(key, mask.cast("double").alias("_mask"), F.posexplode(vector).alias("dim", "_value"))
    pooled = long.groupBy(key, "dim").agg(
        F.sum(F.col("_value") * F.col("_mask")).alias("_total"), F.sum("_mask").alias("_weight")
    )
    return pooled.select(
        key, "dim", (F.col("_total") / F.greatest(F.col("_weight"), F.lit(1e-9))).alias("value")
    )


def collect_vectors(pooled: DataFrame, key: str) -> DataFrame:
    """Turn ``key, dim, value`` rows back into one array per key (at most one entry per dimension)."""
    listed = pooled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_cells"))
    return listed.select(key, F.transform("_cells", lambda cell: cell["value"]).alias("embedding"))


def metrics_record(
    df: DataFrame, key: str, actual: str, predicted: str, block_size: int = 1000
) -> DataFrame:
    """Metrics together with the predictions in key order.

    The predictions are delivered in blocks of ``block_size``, one row each, so the record of a
    large validation set stays a distributed table. A small set yields exactly one row.
    """
    usable = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(
        key, F.col(actual).cast("double").alias("_y"), F.col(predicted).cast("double").alias("_p")
    )
    indexed = with_row_index(usable, [key], "_row")
    blocks = indexed.groupBy(F.floor(F.col("_row") / block_size).alias("block_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_row", "_p"))), lambda x: x["_p"]).alias(
            "val_predictions"
        )
    )
    totals = error_metrics(usable, "_y", "_p")
    whole = totals.select(F.struct("mse", "mae", "n_samples")).scalar()
    return blocks.withColumn("_m", whole).select(
        "block_no",
        F.col("_m.mse").alias("mse"),
        F.col("_m.mae").alias("mae"),
        "val_predictions",
        F.col("_m.n_samples").alias("n_samples"),
    )
