"""Exact duplicates: equal texts after deleting white space, found by skew-safe combining.

Three combines, each on the full normalised text and not only on its digest: inside each map task
(Spark's partial aggregation), per digest and salt, and over the salt winners. A group that holds a
third of all rows reaches any later task as at most one row per salt. The step that gives every row its
group then joins by SHA-256 and length, so as not to send all texts a third time.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SALTS = 32
_SPAN = 1 << 65  # one code point outweighs every id


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest doc_id. A null text
    counts as empty. Null ids rank last; a group of null ids only has a null keep_id and keeps its
    rows. Rows that repeat an id and text whole count in group_size and share the mark of their id.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).alias("n"),
        normalised().alias("norm"),
    )
    # A fixed-width rank, so that the aggregation stays a hash aggregation: most code points first,
    # then the smallest id, null ids last.
    rank = F.expr(
        f"CAST(n AS DECIMAL(10,0)) * CAST({_SPAN} AS DECIMAL(20,0))"
        f" - CAST(coalesce(CAST(doc_id AS DECIMAL(20,0)), CAST({1 << 63} AS DECIMAL(20,0))) AS DECIMAL(20,0))"
    ).cast("decimal(38,0)")
    salted = (
        rows.select(
            F.xxhash64("norm").alias("digest"),
            F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)).alias("salt"),
            "norm",
            rank.alias("rank"),
        )
        .groupBy("digest", "salt", "norm")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("size"))
    )
    winners = (
        salted.groupBy("digest", "norm")
        .agg(F.max("rank").alias("rank"), F.sum("size").alias("group_size"))
        .select(
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.length("norm").alias("n_norm"),
            "rank",
            "group_size",
        )
    )
    members = rows.select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.length("norm").alias("n_norm"),
        rank.alias("own"),
    )
    # rank = n * span - id: the remainder gives the id back.
    ahead = F.expr(f"rank % CAST({_SPAN} AS DECIMAL(20,0))")
    code = F.when(ahead > F.lit(Decimal(_SPAN // 2)), F.lit(Decimal(_SPAN)) - ahead).otherwise(-ahead)
    keep = F.when(code == F.lit(Decimal(1 << 63)), F.lit(None)).otherwise(code.cast("long"))
    return members.join(winners, ["sha", "n_norm"]).select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        (F.col("own") == F.col("rank")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
