"""Row order made explicit: positions, batches, positional binding, heads and latest rows.

Positions over a whole table are counted per range partition, so no task ever holds more than its
own range. The order columns must identify a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingomark.session import stage

PART_NO, PART_POS = "_part_no", "_part_pos"


def range_parts(df: DataFrame, order: Sequence[str], label: str = "ordered") -> DataFrame:
    """Sort ``df`` into range partitions and write it with partition number and position.

    Writing freezes the partition borders: Spark samples them anew whenever a plan runs again.
    Sampling reads the input once more, so an expensive input should be staged before.
    """
    return stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(PART_NO, F.spark_partition_id())
        # The low 33 bits of the id count the rows inside the partition.
        .withColumn(PART_POS, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        label,
    )


def part_starts(parts: DataFrame, size: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Running total of ``size`` before each partition: one row per partition (and key)."""
    totals = parts.groupBy(*keys, PART_NO).agg(size.alias("_size"))
    before = Window.partitionBy(*keys).orderBy(PART_NO).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in the given order."""
    parts = range_parts(df, order)
    # One row per range partition, so its size is bounded by the shuffle partition count.
    starts = F.broadcast(part_starts(parts, F.count(F.lit(1))).select(PART_NO, "_start"))
    return parts.join(starts, PART_NO).select(
        (F.col("_start") + F.col(PART_POS)).alias(name), *df.columns
    )


def with_batch_number(
    df: DataFrame, order: Sequence[str], batch_size: int, name: str = "batch_no"
) -> DataFrame:
    """Number the batches of ``batch_size`` consecutive rows, from 0."""
    indexed = with_row_index(df, order, "_row")
    return indexed.select(*df.columns, F.floor(F.col("_row") / batch_size).alias(name))


def bind_columns(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Pair rows by position; the shorter table is continued with NULLs."""
    a = with_row_index(left, left_order, "row_index")
    b = with_row_index(right, right_order, "row_index")
    return a.join(b, "row_index", "full")


def drop_index(df: DataFrame, name: str = "Unnamed: 0") -> DataFrame:
    """Drop the index column an export left behind; no error when there is none."""
    return df.drop(name)


def head_rows(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_rows(df: DataFrame, key: str, newest_first: Sequence[Column], n: int = 10) -> DataFrame:
    """The newest ``n`` rows per key with their rank (1 = newest).

    Spark keeps only ``n`` rows per key and map task before the shuffle (window group limit), so a
    key that owns a large share of all rows does not end up whole in one task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
