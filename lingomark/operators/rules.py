"""Rule tables of any length over texts: a join and a literal automaton find the few rules that can match."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingomark.session import stage

BLOCK_BYTES = 4 << 20  # of rules per automaton
FEW = 32  # literals that are looked for one by one: a common one would stop the automaton all the time
PIECE = 1 << 20  # characters whose runs are listed at a time
RUN = re.compile("[A-Za-z0-9_]+")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def build(literals: list[tuple[int, str, bool]]):
    """Aho-Corasick automaton over literals; rules that share a literal are told apart by their positions."""
    import ahocorasick

    rules: dict[str, list[tuple[int, bool]]] = {}
    for position, literal, whole in literals:
        rules.setdefault(literal, []).append((position, whole))
    machine = ahocorasick.Automaton()
    for literal, own in rules.items():
        machine.add_word(literal, (len(literal), own))
    machine.make_automaton()
    return machine


def matches(machine, text: str) -> tuple[dict[int, int], set[int]]:
    """Hits of the whole-word rules, and the other rules whose literal occurs.

    Like a regular expression, hits of one rule do not overlap.
    """
    hits: dict[int, int] = {}
    behind: dict[int, int] = {}
    possible: set[int] = set()
    for last, (size, own) in machine.iter(text):
        start = last + 1 - size
        alone = (start == 0 or text[start - 1] not in WORD) and (last + 1 == len(text) or text[last + 1] not in WORD)
        for position, whole in own:
            if not whole:
                possible.add(position)
            elif alone and start >= behind.get(position, 0):
                hits[position] = hits.get(position, 0) + 1
                behind[position] = last + 1
    return hits, possible


def word_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``literal, rows``: runs of ASCII word characters, and ``key, hits`` of rows that hold them.

    Every Arrow batch lists each of its runs once, with all its rows, so a common run is not a row per
    text. Rows that share a key stay apart. NULL texts have no runs.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [count_runs(text.as_py()) for text in batch.column(1)]
            literals = pa.array([literal for counts in counted for literal in counts], pa.string()).dictionary_encode()
            places = literals.indices.to_numpy()
            order = np.argsort(places, kind="stable")
            ends = np.cumsum(np.bincount(places, minlength=len(literals.dictionary)))
            at = np.repeat(np.arange(len(counted)), np.array([len(counts) for counts in counted], np.int64))[order]
            hits = np.array([n for counts in counted for n in counts.values()], np.int64)[order]
            members = pa.StructArray.from_arrays([batch.column(0).take(pa.array(at)), pa.array(hits)], ["key", "hits"])
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [literals.dictionary, pa.ListArray.from_arrays(offsets, members)], ["literal", "rows"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"literal string, rows array<struct<key:{kind},hits:bigint>>")


def count_runs(text: str, piece: int = PIECE) -> Counter[str]:
    """Maximal runs of ASCII word characters; long texts are listed piece by piece."""
    counts: Counter[str] = Counter()
    start = 0
    while start < len(text):
        # A piece does not end inside a run.
        over = RUN.match(text, start + piece)
        end = over.end() if over else start + piece
        counts.update(RUN.findall(text, start, end))
        start = end
    return counts


def rule_matches(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """``key, rule_id, hits`` of the rules that hit, from a table of any number of rules.

    ``rules`` has ``position`` (unique), ``rule_id`` (text), ``pattern`` and ``literal``, a string that every match
    of the pattern contains (NULL where none is known), and ``whole``: whether the pattern is just the
    literal between ASCII word boundaries. NULL texts have no hits. Three kinds of rules:

    * Whole words of ASCII word characters hit the runs of a text that equal them. The runs are counted
      in one scan and joined to the rules, however many there are: the cost grows with the texts alone.
    * Other literals are looked for by an automaton (a few of parts of words, one by one). It counts whole ones and finds the others that may
      match; only these run as regular expressions. Such rules go to the tasks in blocks of bounded size,
      one scan each.
    * Rules without a literal run as regular expressions on every text.

    Texts are not shuffled: patterns come to them.
    """
    rules = stage(rules.select("position", "rule_id", "pattern", "literal", "whole"), "rules")
    word = F.coalesce(F.col("whole") & F.col("literal").rlike(r"\A[A-Za-z0-9_]+\z"), F.lit(False))
    listed = F.coalesce(F.length("literal") > 0, F.lit(False))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = word_runs(rows, "key", "text").join(rules.where(word).select("literal", "rule_id"), "literal")
    counted = found.select("rule_id", F.inline("rows")).select("key", "rule_id", "hits")

    others = rules.where(listed & ~word)
    cells = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("literal", "pattern", "rule_id")]
    size = others.agg(F.sum(cells[0] + cells[1] + cells[2])).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = others.where(F.pmod(F.xxhash64("literal"), F.lit(blocks)) == k)
        block = [tuple(r) for r in part.select("literal", "whole", "rule_id", "pattern").collect()]
        if block:
            scanned = _scan(rows, rows.sparkSession.sparkContext.broadcast(block))
            hits = F.concat("hits", _tried(F.col("text"), F.col("possible")))
            counted = counted.unionByName(_listed(scanned, hits))

    # One array for all tasks; sorted, so that it is the same in each.
    slow = rules.where(~listed).agg(F.sort_array(F.collect_list(F.struct("position", "rule_id", "pattern")))).scalar()
    counted = counted.unionByName(_listed(rows.withColumn("slow", slow), _tried(F.col("text"), F.col("slow"))))
    return counted.withColumnRenamed("key", key)


def _tried(text: Column, rules: Column) -> Column:
    """The rules of an array whose patterns hit a text, with their hits."""
    counted = F.transform(
        rules,
        lambda r: F.struct(r["rule_id"].alias("rule_id"), F.regexp_count(text, r["pattern"]).cast("long").alias("hits")),
    )
    return F.filter(counted, lambda r: r["hits"] > 0)


def _listed(rows: DataFrame, hits: Column) -> DataFrame:
    """One row per hit rule. The outer form keeps Spark from adding a filter that would compute the hits twice."""
    return rows.select("key", F.inline_outer(hits)).where(F.col("hits").isNotNull())


def _scan(rows: DataFrame, block) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = block.value
        few = [k for k, (_, whole, _, _) in enumerate(listed) if not whole]
        few = few if len(few) <= FEW else []
        literals = [(k, literal, bool(whole)) for k, (literal, whole, _, _) in enumerate(listed) if whole or not few]
        machine = build(literals) if literals else None
        hit = pa.list_(pa.struct([("rule_id", pa.string()), ("hits", pa.int64())]))
        rule = pa.list_(pa.struct([("rule_id", pa.string()), ("pattern", pa.string())]))
        for batch in batches:
            hits, possible = [], []
            for text in batch.column(1):
                value = text.as_py()
                own, other = matches(machine, value) if machine else ({}, set())
                other.update(k for k in few if listed[k][0] in value)
                hits.append([{"rule_id": listed[k][2], "hits": n} for k, n in own.items()])
                possible.append([{"rule_id": listed[k][2], "pattern": listed[k][3]} for k in sorted(other)])
            # Only rows with rules to try keep their text.
            texts = pc.if_else(pa.array([bool(other) for other in possible], pa.bool_()), batch.column(1), None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), texts, pa.array(hits, hit), pa.array(possible, rule)], ["key", "text", "hits", "possible"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    hit, rule = "array<struct<rule_id:string,hits:bigint>>", "array<struct<rule_id:string,pattern:string>>"
    return rows.mapInArrow(run, f"key {kind}, text string, hits {hit}, possible {rule}")
