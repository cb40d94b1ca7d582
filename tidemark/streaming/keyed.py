"""Keyed state with timers: a history that is frozen by day, from a stream whose days close by the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .twins import HISTORY, run_into

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
EPOCH = date(1970, 1, 1)


class DayBuffer(StatefulProcessor):
    """State of a key: totals of its closed days, and the events of days that are still open, one row each.

    A key has one timer, for the end of its earliest open day. When the watermark has passed it, the events of all closed days are given out, each with the
    totals of the days before, and then added to them. idle_days: totals go when a key has had no event for so many days; a later one starts anew.
    """

    def __init__(self, idle_days: int | None = None):
        self.idle_days = idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n bigint, total double, last_end bigint, timer bigint")
        self.open = handle.getListState("open", "ends bigint, event_id bigint, value double")

    def _known(self) -> tuple[int, float, int, int]:
        return self.totals.get() or (0, 0.0, 0, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.ends, r.event_id, r.value) for r in rows]  # one key's events of one micro-batch
        if new:
            self.open.appendList(new)
            n, total, last, timer = self._known()
            first = min(r[0] for r in new)
            if not timer or first < timer:
                if timer:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                self.totals.update((n, total, last, first))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.open.get())
        n, total, last, _ = self._known()
        closed = [r for r in rows if r[0] <= now]
        rest = rows[len(closed) :]
        for end, group in groupby(closed, key=itemgetter(0)):
            if self.idle_days is not None and last and end - last > self.idle_days * DAY_MS:
                n, total = 0, 0.0
            day, events, value = EPOCH + timedelta(milliseconds=end - DAY_MS), 0, 0.0
            for _, event_id, v in group:
                yield Row(user_id=key[0], event_id=event_id, day=day, events_before=n, value_before=total)
                events, value = events + 1, value + v
            n, total, last = n + events, total + value, end
        if closed:
            if rest:
                self.open.put(rest)
            else:
                self.open.clear()
        forgets = last + self.idle_days * DAY_MS + 1 if self.idle_days is not None and last else 0
        if not rest and not closed and forgets and now >= forgets:
            self.totals.clear()
            return
        timer = rest[0][0] if rest else forgets
        if timer:
            self.handle.registerTimer(timer)
        self.totals.update((n, total, last, timer))

    def close(self) -> None:
        pass


def keyed_history(events: DataFrame, delay: str = "1 day", key: str = "user_id", ts: str = "ts", idle_days: int | None = None) -> DataFrame:
    """For each event of a stream, how many events of its key lie on earlier days, and their value.

    A day closes when the watermark (the latest day's end less `delay`) reaches its end; then its rows are given out, once. Until then events may come
    in any order and in any micro-batch. Events of closed days come too late: Spark drops them by the watermark and counts them in the progress of the
    query (`late_rows`). State has a row for each event of an open day, and one for each key, or with idle_days for each key
    seen in so many days. Events of one key and open day meet in one task; where that may be too many, `twins.frozen_history_batches` sums them first.
    """
    day = F.col(ts).cast("timestamp").cast("date")
    rows = events.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("user_id"), F.col("event_id").cast("bigint").alias("event_id"), F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value"), F.date_add(day, 1).cast("timestamp").alias("day_end"))
    marked = rows.withWatermark("day_end", delay).withColumn("ends", F.unix_millis("day_end"))
    return marked.groupBy("user_id").transformWithState(DayBuffer(idle_days), HISTORY, "append", "eventTime")


class state_in_rocksdb:
    """While it holds, queries that start keep their state in RocksDB, which such processors need."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.was = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(PROVIDER, self.was) if self.was else self.spark.conf.unset(PROVIDER)


def run_keyed(stream: DataFrame, root: str) -> dict[str, int]:
    """run_into with the state in RocksDB."""
    with state_in_rocksdb(stream.sparkSession):
        return run_into(stream, root)
