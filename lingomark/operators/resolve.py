"""Manifest rows against files, and feature records against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingomark.session import stage

# Keys that hold more than this part of all rows are spread over several tasks.
HOT_PARTS = 4096


def resolve(manifest: DataFrame, files: DataFrame, key: str, found: str) -> DataFrame:
    """Every manifest row with its file, or with the error that names the missing file.

    ``files`` has one row per key and a column ``found`` that is never NULL. A key repeated many
    times in the manifest is split by the adaptive skew join.
    """
    joined = manifest.join(files, key, "left")
    message = F.concat(F.lit("Audio file not found: "), F.col(key).cast("string"))
    return joined.withColumn("error", F.when(F.col(found).isNull(), message))


def existing(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return manifest.join(files.select(key), key, "left_semi")


def missing(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows without a partner; also the completeness check of embedding tables."""
    return manifest.join(files.select(key), key, "left_anti")


def merge_features(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One record per key from two feature tables; on equal names the right table wins."""
    right_names = set(right.columns)
    kept = [c for c in left.columns if c == key or c not in right_names]
    return left.select(*kept).join(right, key)


def join_content(
    left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], parts: int = HOT_PARTS
) -> DataFrame:
    """Left join with a table that has a key once, when a few keys may hold most rows of ``left``.

    A key with more than 1/``parts`` of all rows is dealt over several tasks by a hash of the columns
    ``spread``, and its row of ``right`` goes to all of them. Fewer than ``parts`` keys can be as
    frequent, which bounds their table. Rows with a NULL key are dealt likewise and find nothing.
    ``left`` is read twice: stage it when it is expensive.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_times"))
    share = F.col("_times") * parts / left.agg(F.count(key)).scalar()
    frequent = counts.withColumn("_copies", F.ceil(share).cast("int")).where(F.col("_copies") > 1)
    hot = F.broadcast(stage(frequent.select(key, "_copies"), "hot-keys"))
    place = F.xxhash64(*spread)
    salt = F.when(F.col(key).isNull(), -1 - F.pmod(place, F.lit(parts))).otherwise(
        F.coalesce(F.pmod(place, F.col("_copies")), F.lit(0))
    )
    dealt = left.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_copies")
    copies = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_copies")
    return dealt.join(copied, [key, "_salt"], "left").drop("_salt")
