"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are sorted into range partitions and written once. The byte totals of the partitions give the
prefix sums at their borders; a cut at an equal target falls into one known partition, and only the
few partitions with a cut are summed row by row. Everything else is an expression per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingomark.operators import ordering

SHARDS = 8
_SIZE, _TIE = "_size", "_tie"


def balanced_shards(df: DataFrame, size: Column, order: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 inside the shard, in the given order).

    A row belongs to the shard in whose equal part of the total size its middle lies, so a shard is
    off its target by at most one row on either side. Sizes have to be positive. Nulls in the order
    columns come first; rows that are equal in them follow in any order, and may be split between
    shards. Existing columns ``shard`` and ``slot`` are replaced. An empty table stays empty.
    """
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # The row's own number splits runs of equal order values between range partitions.
    numbered = df.select(*names, size.cast("long").alias(_SIZE)).withColumn(_TIE, F.monotonically_increasing_id())
    parts = ordering.range_parts(numbered, [*order, _TIE], "shards")
    part, pos = ordering.PART_NO, ordering.PART_POS
    # One row per range partition: bounded by the number of shuffle partitions.
    totals = sorted(
        (r[part], r["bytes"], r["rows"])
        for r in parts.groupBy(part).agg(F.sum(_SIZE).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    )
    total = sum(t[1] for t in totals)
    first_byte, first_row, at, row = {}, {}, 0, 0
    for no, n_bytes, n_rows in totals:
        first_byte[no], first_row[no] = at, row
        at, row = at + n_bytes, row + n_rows
    holders = sorted({no for no, n_bytes, _ in totals for k in range(1, shards)
                      if first_byte[no] * shards <= total * k <= (first_byte[no] + n_bytes) * shards})
    before = Window.partitionBy(part).orderBy(pos)
    start = F.element_at(F.create_map(*[F.lit(x) for no in holders for x in (no, first_byte[no])]), F.col(part)) if holders else F.lit(0)
    middles = (
        parts.where(F.col(part).isin(holders))
        .select(part, pos, ((start + F.sum(_SIZE).over(before)) * 2 - F.col(_SIZE)).alias("middle2"))
    )
    cuts = middles.agg(
        *[F.min(F.when(F.col("middle2") * shards >= 2 * total * k, F.struct(part, pos))).alias(f"c{k}") for k in range(1, shards)]
    ).first()
    firsts, shard = [0], F.lit(0)
    for k in range(1, shards):
        cut = cuts[f"c{k}"]
        if cut is None:  # no row has its middle behind the target
            firsts.append(row)
            continue
        firsts.append(first_row[cut[part]] + cut[pos])
        behind = (F.col(part) > cut[part]) | ((F.col(part) == cut[part]) & (F.col(pos) >= cut[pos]))
        shard = shard + behind.cast("int")
    starts = F.broadcast(ordering.part_starts(parts, F.count(F.lit(1))).select(part, "_start"))
    first = F.element_at(F.array(*[F.lit(int(f)).cast("long") for f in firsts]), F.col("shard") + 1)
    return (
        parts.join(starts, part)
        .withColumn("shard", shard.cast("int"))
        .select(*names, "shard", (F.col("_start") + F.col(pos) - first).alias("slot"))
    )


def document_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents lie in the order of doc_id (null first), then of their text's CRC. A null text has no
    bytes and size 1.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")
    )
    return balanced_shards(rows, F.col("size"), ["doc_id", "text_crc32"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i::BIGINT, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 1 AS size FROM documents),
b AS (
  SELECT doc_id, size, list_prepend(4294967295::BIGINT, list_transform(
           regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM d),
c AS (
  SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM b, t),
s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
p AS (SELECT *, least(7, ((2 * upto - size) * 8) // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM p
"""
