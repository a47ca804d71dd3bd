"""First-seen tracking of a stream of sightings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import state as S


def first_sightings(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """(day, n): a tumbling count by day, late rows up to the delay included."""
    days = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.to_date("w.start").alias("day"), "n")


class Tracker(StatefulProcessor):
    """Keeps, for each key, the time it was first seen; emits a row when that happens. Forgets keys not seen for so many days, if given."""

    def __init__(self, days: int | None):
        self.ttl = [int(timedelta(days=days).total_seconds() * 1000)] if days else []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "first timestamp", *self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        earliest = min(f["ts"].min() for f in rows)
        known = self.first.exists()
        first = self.first.get()[0] if known else earliest
        self.first.update((first,))
        if not known:
            yield pd.DataFrame({"key": [key[0]], "first_seen": [first]})

    def close(self) -> None:
        pass


def tracked(stream: DataFrame, key: str, time: str, forget_after: int | None = S.TTL_DAYS) -> DataFrame:
    """(key, first_seen) when a key is first seen, with a state whose TTL in days each sighting renews. Needs the RocksDB state store.

    A TTL goes by processing time, for which Spark plans batches without end; give None for queries that stop when all is read.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).alias("ts"))
    return rows.groupBy("key").transformWithStateInPandas(Tracker(forget_after), "key string, first_seen timestamp", "Append", "ProcessingTime" if forget_after else "None")


def run_daily(stream: DataFrame, root: str, checkpoint: str, today: Callable[[], str], on_batch: Callable[[dict], None] = lambda flow: None) -> StreamingQuery:
    """Marks each micro-batch of listings as a run: the state table is replaced as a whole, so a repeated batch changes nothing."""
    from ..sources import store

    def batch(rows: DataFrame, number: int) -> None:
        marked = S.mark(rows, store.load_state(rows.sparkSession, root), today())
        store.save_state(marked.state, root)
        on_batch(marked.flow.first().asDict())

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
