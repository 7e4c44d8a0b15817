"""Exact, seeded train/validation split without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
# Digits by which a histogram of digests grows finer, at most 65536 rows each, and the digests that are
# put in order one by one.
DIGITS = 4
FEW = 1 << 17
MD5_DIGITS = 32


def _digest(key: str, seed: int) -> Column:
    """Digest of seed and key; NULL keys have one of their own."""
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.md5(F.lit(f"{seed} NULL")))


def _last_validation_digest(df: DataFrame, key: str, share: float, seed: int) -> str | None:
    """Digest of the last validation row in digest order; None without validation rows.

    Histograms of growing prefixes narrow the digests down until few are left under one prefix, which
    the first does for any table of less than some billion rows.
    """
    hashed = df.select(_digest(key, seed).alias("digest"))
    prefix, wanted, digits = "", None, DIGITS
    while True:
        rows = hashed.where(F.col("digest").startswith(prefix))
        histogram = rows.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        # At most 65536 rows, or the few digests of one prefix.
        upto = F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        everything = F.sum("n").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rank = F.ceil(everything * F.lit(share)) if wanted is None else F.lit(wanted)
        running = histogram.select("prefix", "n", upto.alias("upto"), rank.alias("wanted"))
        border = running.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted"))).first()
        if border is None:
            return None
        prefix = border["prefix"]
        if digits == MD5_DIGITS:
            return prefix
        wanted = border["wanted"] - (border["upto"] - border["n"])
        digits = MD5_DIGITS if border["n"] <= FEW else digits + DIGITS


def exact_split(df: DataFrame, key: str, share: float, seed: int = SEED) -> DataFrame:
    """Mark ``ceil(n * share)`` rows as ``val`` and the others as ``train`` (column ``split``).

    Rows are ordered by the MD5 of seed and key, so the parts do not depend on partitioning or
    engine. Two passes over the key column find the digest of the last validation row, at once; the
    table itself is then only compared with it: no shuffle, no sort, one read. Rows that share a key
    stay together.
    """
    last = _last_validation_digest(df, key, share, seed)
    chosen = F.lit(False) if last is None else _digest(key, seed) <= F.lit(last)
    return df.withColumn("split", F.when(chosen, F.lit("val")).otherwise(F.lit("train")))
