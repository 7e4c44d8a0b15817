"""Filter interaction audit: what each filter removes in every order of the filters.

A document only matters through the set of filters it fails, its part and its labels. So documents are
counted once per (part, set), at most 2**n cells a part, and every order is replayed on the cells alone:
a fold over the order walks the filters, ``transform`` runs it for all orders, and the cells' arrays of
(order, step) structs, weighted with the cells' counts, are added element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingomark.session import stage

BLANKS = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_fails(text: str = "text") -> Column:
    """Bits 0 to 3 (filters A to D) that a text fails; needs the text's words in ``_words``."""
    n, distinct = F.size("_words").cast("long"), F.size(F.array_distinct("_words")).cast("long")
    capitals = F.length(F.regexp_replace(F.col(text), "[^A-Z]+", "")).cast("long")
    fails = [
        n < 50,
        distinct * 100 < n * 65,
        capitals * 100 > F.length(text).cast("long") * 5,
        F.col(text).rlike("[#$%&*|]"),
    ]
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))


def label_marks(labels: DataFrame) -> DataFrame:
    """doc_id, good and toxic (0 or 1): whether any label row of the document says so."""
    mark = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "quality", "toxic")
    return known.groupBy("doc_id").agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))


def fail_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of the failed filters), n, good and toxic: documents per part and failed set.

    Equal texts fail A to D alike, so only their numbers per part are needed to settle E: of rows with
    equal texts (SHA-256 of the whole text) those with the smallest doc_id pass. Copies are added up in
    the map tasks, before any shuffle by text.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = texts.withColumn("_words", F.array_remove(F.split("text", BLANKS), ""))
    rows = words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), text_fails().alias("mask"))
    marks = F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    marked = rows.join(label_marks(labels), "doc_id", "left").select("doc_id", "part", "sha", "mask", *marks)
    cell = ["sha", "part", "mask", "good", "toxic"]
    repeats = marked.groupBy("doc_id", *cell).agg(F.count(F.lit(1)).alias("n"))
    copies = stage(
        repeats.groupBy(cell).agg(
            F.sum("n").alias("n"),
            F.min("doc_id").alias("least"),
            F.min_by("n", "doc_id").alias("n_least"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_loose"),
        ),
        "copies",
    )
    first = copies.groupBy("sha").agg(F.min("least").alias("first"))
    settled = copies.join(first, "sha").withColumn(
        "passing", F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0) + F.col("n_loose")
    )
    last = 1 << FILTERS.index("E")
    split = F.array(
        F.struct("mask", F.col("passing").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(last)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )
    each = settled.select("part", "good", "toxic", F.explode(split).alias("at")).where(F.col("at.n") > 0)
    return each.groupBy("part", F.col("at.mask").alias("mask")).agg(
        F.sum("at.n").alias("n"),
        F.sum(F.col("at.n") * F.col("good")).alias("good"),
        F.sum(F.col("at.n") * F.col("toxic")).alias("toxic"),
    )


def _replay(order: Column, cell: Column) -> Column:
    """The steps of one order for one cell: structs of the filter and the weighted counts."""

    def step(state: Column, number: Column) -> Column:
        mask = cell["mask"]
        fails = F.getbit(mask, number) == 1
        gone, alone = state["gone"], F.bit_count(mask) == 1
        weight = lambda when, name: F.when(when, cell[name]).otherwise(F.lit(0).cast("long"))
        counts = F.struct(
            number.alias("filter"),
            weight(~gone & ~fails, "n").alias("kept"),
            weight(~gone & fails, "n").alias("removed"),
            weight(gone & fails, "n").alias("redundant"),
            weight(fails & alone, "n").alias("unique_fails"),
            weight(~gone & fails, "good").alias("good_lost"),
            weight(~gone & fails, "toxic").alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    empty = F.expr(f"CAST(array() AS ARRAY<STRUCT<filter: INT, {', '.join(f'{c}: BIGINT' for c in COUNTS)}>>)")
    start = F.struct(F.lit(False).alias("gone"), empty.alias("steps"))
    return F.aggregate(order, start, step, lambda state: state["steps"])


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``cells`` (part, mask, n, good, toxic).

    The orders are a constant array of n! orders, which travels with the plan. A part's cells, at most
    2**n, are one row; no cells give no rows.
    """
    names = ["".join(p) for p in permutations(filters)]
    orders = F.lit([[filters.index(f) for f in name] for name in names])
    n = len(filters)

    def replayed(cell: Column) -> Column:
        return F.flatten(F.transform(orders, lambda order: _replay(order, cell)))

    def added(total: Column, own: Column) -> Column:
        return F.struct(total["filter"].alias("filter"), *((total[c] + own[c]).alias(c) for c in COUNTS))

    def shapley(steps: Column) -> Column:
        of = lambda k: F.aggregate(
            steps, F.lit(0).cast("long"), lambda total, s: total + F.when(s["filter"] == k, s["removed"]).otherwise(0)
        )
        return F.array(*(of(k) for k in range(n)))

    cell = F.struct(F.col("mask").cast("long").alias("mask"), "n", "good", "toxic")
    parts = cells.groupBy("part").agg(F.collect_list(cell).alias("cells"))
    folded = parts.select("part", F.transform("cells", replayed).alias("folds"))
    merged = folded.select(
        "part",
        F.aggregate(
            F.slice("folds", F.lit(2), F.greatest(F.size("folds") - 1, F.lit(0))),
            F.col("folds")[0],
            lambda total, own: F.zip_with(total, own, added),
        ).alias("steps"),
    )
    rows = merged.select("part", shapley(F.col("steps")).alias("shares"), F.posexplode("steps").alias("at", "s"))
    return rows.select(
        "part",
        F.element_at(F.lit(names), F.floor(F.col("at") / n).cast("int") + 1).alias("filter_order"),
        (F.col("at") % n + 1).cast("int").alias("step"),
        *(F.col("s")[c].alias(c) for c in COUNTS),
        F.element_at("shares", F.col("s")["filter"] + 1).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), filter_order and step of the filters A to E.

    A null text counts as empty, a null source is the part ''. Rows without an id have no label, pass E
    and fail nobody else on it. Rows that repeat an id and text do not fail E by each other. A document
    with several label rows is good, or toxic, if one of them says so; null labels say nothing. Other
    columns are ignored; an empty table gives an empty result.
    """
    return audit(fail_cells(docs, labels))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
f AS (
  SELECT doc_id, part,
         [len(words) < 50,
          100 * len(list_distinct(words)) < 65 * len(words),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          doc_id > first_id] AS fails
  FROM w),
cells AS (
  SELECT part, fails, count(*) AS n,
         count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM f LEFT JOIN labels USING (doc_id) GROUP BY part, fails),
orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l)
  WHERE NOT contains(filter_order, l)),
steps AS (
  SELECT filter_order, step, ord(filter_order[step]) - 64 AS filter,
         list_transform(range(1, step), lambda i: ord(filter_order[i]) - 64) AS earlier
  FROM orders, range(1, 6) AS s(step) WHERE length(filter_order) = 5),
walked AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails[filter] AS bad,
         len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM cells, steps),
summed AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (bad AND single), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND bad), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND bad), 0)::BIGINT AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM summed
"""
