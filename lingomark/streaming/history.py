"""Keyed stream state: the newest results per user."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: results kept per user.
HISTORY_SIZE = 10

ITEMS = "user_id bigint, ts bigint, item_id bigint, cleared boolean"
POINT = "ts bigint, item_id bigint"
OUTPUT = "user_id bigint, version bigint, items array<struct<ts: bigint, item_id: bigint>>"

# Fixed value: Spark's state store that keeps its state in files and not on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _reduce_batches(size: int):
    """Per Arrow batch and user: the newest items and the newest clear event.

    Runs before the shuffle, so a user who owns a large share of a micro-batch sends a few rows
    per batch to the task that holds the state.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            # Arrow keeps ids whole where a NULL would turn them into floats; NULL is a user of its own.
            order = pc.sort_indices(
                rows, sort_keys=[("user_id", "ascending"), ("cleared", "ascending"), ("ts", "descending"), ("item_id", "descending")]
            )
            newest = rows.take(order)
            kept, last, n = [], None, 0
            for k, key in enumerate(zip(newest["user_id"].to_pylist(), newest["cleared"].to_pylist())):
                n = n + 1 if key == last else 1
                last = key
                if n <= (1 if key[1] else size):
                    kept.append(k)
            yield newest.take(pa.array(kept, pa.int64()))

    return reduce


class Newest(StatefulProcessor):
    """State of one user: the newest items, the newest clear event and the number of lists sent.

    A clear event is an input like others and drops all items up to it, also those that arrive later.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", POINT)
        self.clear = handle.getValueState("clear", POINT)
        self.version = handle.getValueState("version", "version bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {tuple(item) for item in self.items.get()}
        clear = tuple(self.clear.get()) if self.clear.exists() else None
        for part in rows:
            for ts, item_id, cleared in zip(part["ts"].tolist(), part["item_id"].tolist(), part["cleared"].tolist()):
                if cleared:
                    clear = max(clear or (ts, item_id), (ts, item_id))
                else:
                    kept.add((ts, item_id))
            kept = set(heapq.nlargest(self.size, (i for i in kept if clear is None or i > clear)))
        newest = sorted(kept, reverse=True)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        # An empty list state is one that is not there.
        self.items.put(newest) if newest else self.items.clear()
        if clear is not None:
            self.clear.update(clear)
        self.version.update((version,))
        listed = [{"ts": ts, "item_id": item_id} for ts, item_id in newest]
        yield pd.DataFrame({"user_id": pd.array([_user(key[0])], dtype="Int64"), "version": [version], "items": [listed]})

    def close(self) -> None:
        pass


def _user(packed: str) -> int | None:
    return int(packed) if packed else None


def history_updates(events: DataFrame, size: int = HISTORY_SIZE) -> DataFrame:
    """Stream of ``user_id, version, items``: the whole list again whenever a user's list changes.

    The state of a user is a list of at most ``size`` items, in the files of RocksDB. Queries that start
    after this call use that store; a stream keeps the one it began with.

    ``events`` has the columns of ``ITEMS``. Order is by ``ts`` and ``item_id``, not by arrival, so
    the final list does not depend on how the stream was cut; a clear event drops everything up
    to it. Events of a NULL user have a list of their own; repeated events count once.
    """
    reduced = events.select("user_id", "ts", "item_id", "cleared").mapInArrow(_reduce_batches(size), ITEMS)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # State keys are never NULL.
    keyed = reduced.withColumn("user_key", F.coalesce(F.col("user_id").cast("string"), F.lit("")))
    return keyed.groupBy("user_key").transformWithStateInPandas(Newest(size), OUTPUT, "append", "none")


def newest_lists(updates: DataFrame) -> DataFrame:
    """The newest version of every user's list, one row per user.

    Also the compaction of the log of lists: written in its place, it holds each user once.
    """
    newest = F.max_by(F.struct("version", "items"), "version").alias("last")
    return updates.groupBy("user_id").agg(newest).select("user_id", "last.version", "last.items")


def current_history(updates: DataFrame) -> DataFrame:
    """Newest list of every user, one row per item with its rank (1 = newest)."""
    ranked = newest_lists(updates).select("user_id", F.posexplode("items").alias("pos", "item"))
    return ranked.select(
        "user_id", (F.col("pos") + 1).alias("rank"), F.col("item.ts").alias("ts"), F.col("item.item_id").alias("item_id")
    )
