"""Keyed state over streams: the latest row of each key, and alerts that open and close themselves.

Both keep their state in Spark's state store (RocksDB), a key's state apart from all others', and
both take the event time as a plain number, so that Spark drops no row for being late: the
watermark only fires timers, and a late row is told from others by the alerts' processor itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
ALERT = "cluster string, kind string, hour_ms long, n long, z double"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def state_rows(events: DataFrame) -> DataFrame:
    """key, at (microseconds), seq, what, value of the rows that have a key and a time."""
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return events.select(F.col("user_id").alias("key"), at.alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("what"), "value").where("key is not null and at is not null")


def latest(rows: DataFrame) -> DataFrame:
    """The latest row of each key by (at, seq, what, value), by aggregation: what the stream comes to."""
    top = F.max(F.struct("at", "seq", "what", "value")).alias("r")
    return rows.groupBy("key").agg(top).select("key", "r.*")


def latest_stream(rows: DataFrame) -> DataFrame:
    """A stream of changes of the latest row of each key: the row, and rows, how many of the key came so far. For update mode.

    Repeated and older rows change nothing and are not told: beside a key's row its state holds the time of the batch
    that brought it (of equal rows the first one's), and only rows that this batch brought are passed on. Should two batches bear one
    time, a row may be told twice, but a change is never left out.
    """
    batch = F.unix_micros(F.current_timestamp())  # in a stream, the same for all rows of a batch
    top = F.max(F.struct("at", "seq", "what", "value", "came")).alias("r")
    held = rows.withColumn("came", -batch).groupBy("key").agg(top, F.count("*").alias("rows"))
    return held.where(F.col("r.came") == -batch).select("key", "r.at", "r.seq", "r.what", "r.value", "rows")


class SpikeAlerts(StatefulProcessor):
    """A cluster's hours, closed by the watermark, against the hours of the week before; see alert_stream."""

    def __init__(self, least: float, idle_hours: int):
        self.least, self.idle = least, idle_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "hour long", "n long")
        self.past = handle.getMapState("past", "hour long", "n long")
        self.spell = handle.getValueState("spell", "hour long")  # the last spiking hour

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        late = 0
        for batch in rows:
            hours = (batch["at"].to_numpy(dtype=np.int64) // 1000) // HOUR_MS * HOUR_MS
            on_time = hours + HOUR_MS > closed
            late += int((~on_time).sum())
            for hour, n in zip(*np.unique(hours[on_time], return_counts=True)):
                known = self.open.getValue((int(hour),))
                if known is None:
                    self.handle.registerTimer(int(hour) + HOUR_MS - 1)
                self.open.updateValue((int(hour),), ((known[0] if known else 0) + int(n),))
        if late:
            yield pd.DataFrame([(key[0], "late", closed, late, None)], columns=["cluster", "kind", "hour_ms", "n", "z"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for hour in sorted(h[0] for h in self.open.keys()):
            if hour + HOUR_MS - 1 > now:
                break
            n = self.open.getValue((hour,))[0]
            self.open.removeKey((hour,))
            out += self._close(key[0], hour, n)
        last = self.spell.get()[0] if self.spell.exists() else None
        if last is not None and last + (self.idle + 1) * HOUR_MS - 1 <= now:
            self.spell.clear()
            out.append((key[0], "resolved", last, 0, None))
        if out:
            yield pd.DataFrame(out, columns=["cluster", "kind", "hour_ms", "n", "z"])

    def _close(self, cluster, hour: int, n: int) -> list[tuple]:
        hours = {h[0]: c[0] for h, c in self.past.iterator()}
        for old in [h for h in hours if h < hour - 168 * HOUR_MS]:
            self.past.removeKey((old,))
            del hours[old]
        counts = np.array([hours[h] for h in sorted(hours)], dtype=float)
        self.past.updateValue((hour,), (n,))
        spread = counts.std(ddof=1) if len(counts) > 1 else 0.0
        z = (n - counts.mean()) / spread if spread else None
        if z is None or z <= self.least:
            return []
        last = self.spell.get()[0] if self.spell.exists() else None
        self.spell.update((hour,))
        self.handle.registerTimer(hour + (self.idle + 1) * HOUR_MS - 1)
        ended = [(cluster, "resolved", last, 0, None)] if last is not None and hour >= last + (self.idle + 1) * HOUR_MS else []
        return ended + ([(cluster, "raised", hour, n, float(z))] if last is None or hour - last > HOUR_MS else [])

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, late: str = "2 hours", least: float = 2.0, idle_hours: int = 3) -> DataFrame:
    """cluster, kind, hour_ms, n, z: hourly spikes of a stream against each cluster's week before.

    An hour is judged when the watermark passes its end. `raised` opens an alert unless the hour before spiked, too;
    `resolved` closes a spell, named by its last spiking hour, when the watermark is more than idle_hours past it.
    Rows of an hour that is closed are not counted in it but told as `late`, with their number and the watermark that was.
    """
    timed = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    rows = timed.select(F.coalesce("event_type", F.lit("")).alias("cluster"), F.unix_micros("t").alias("at")).where("at is not null")  # without t no row is dropped
    return rows.groupBy("cluster").transformWithStateInPandas(SpikeAlerts(least, idle_hours), ALERT, "Append", "EventTime")
