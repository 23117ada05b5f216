"""Streams whose state ends by itself: bursts that fire after a quiet gap, and grants whose accounts are forgotten when nothing came for long.

Both keep their state in RocksDB, which transformWithState asks for; the functions set it for the session unless a store is set. Events behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BURST = "key string, started_ms long, fires_ms long, n long, first_value string, last_value string"


class Burst(StatefulProcessor):
    """One burst a key: every event moves the timer, and when it fires the burst goes out."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "first_ms long, last_ms long, n long, first_value string, last_value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.held.get()) if self.held.exists() else None
        before = held and held[1] + self.gap_ms
        for row in sorted(rows, key=lambda r: (r["ms"], r["value"] or "")):
            ms, value = row["ms"], row["value"]
            if held and ms >= held[1] + self.gap_ms:  # the timer was due, but the watermark is not there yet
                yield self._out(key, held)
                held = None
            if held is None:
                held = (ms, ms, 1, value, value)
            elif ms < held[0]:  # came late
                held = (ms, held[1], held[2] + 1, value, held[4])
            else:
                held = (held[0], max(ms, held[1]), held[2] + 1, held[3], value if ms >= held[1] else held[4])
        after = held[1] + self.gap_ms
        if before != after:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        self.held.update(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.held.exists():
            yield self._out(key, tuple(self.held.get()))
            self.held.clear()

    def close(self) -> None:
        pass

    def _out(self, key, held: tuple) -> Row:
        first, last, n, first_value, last_value = held
        return Row(key=key[0], started_ms=first, fires_ms=last + self.gap_ms, n=n, first_value=first_value, last_value=last_value)


def debounced(events: DataFrame, key: str, ts: str, value: str, gap_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """key, started_at, fires_at, n, first_value, last_value of a stream: a key's events fire once after a quiet gap, with the first and the last value. Of values at one time the greatest is last."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("ms"), F.col(value).cast("string").alias("value"))
    bursts = _stateful(rows.withWatermark("ts", late), "key", Burst(gap_seconds * 1000), BURST)
    return bursts.select("key", F.timestamp_millis("started_ms").alias("started_at"), F.timestamp_millis("fires_ms").alias("fires_at"), "n", "first_value", "last_value")


GRANT = "account string, event_id string, period long, granted double"


class Grant(StatefulProcessor):
    """An account's last period, the ids it has seen, and a timer that ends both."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "period long, ends_ms long")
        self.seen = handle.getMapState("seen", "event_id string", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last, ends = tuple(self.last.get()) if self.last.exists() else (None, None)
        before = ends
        for row in sorted(rows, key=lambda r: (r["ms"], r["event_id"])):
            if self.seen.containsKey((row["event_id"],)):
                continue
            self.seen.updateValue((row["event_id"],), (row["ms"],))
            fresh = last is None or row["period"] > last
            last = row["period"] if fresh else last
            ends = max(ends or 0, row["ms"] + self.keep_ms)
            yield Row(account=key[0], event_id=row["event_id"], period=row["period"], granted=float(row["amount"]) if fresh else 0.0)
        if ends != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)
        if last is not None:
            self.last.update((last, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def grants(events: DataFrame, keep: str = "400 days", late: str = "30 days") -> DataFrame:
    """account, event_id, period, granted of a stream of events (account, event_id, ts, period, amount): a replayed id is left out, and a period that is not later than the last one applied grants 0.

    An account without events for ``keep`` is forgotten, its ids too; keep must be longer than replays take.
    """
    keep_ms = int(events.sparkSession.range(1).select((F.unix_millis(F.expr(f"timestamp_seconds(0) + interval {keep}"))).alias("ms")).first()["ms"])
    rows = events.select(F.col("account").cast("string"), F.col("event_id").cast("string"), "ts", F.unix_millis("ts").alias("ms"), F.col("period").cast("long"), F.col("amount").cast("double"))
    return _stateful(rows.withWatermark("ts", late), "account", Grant(keep_ms), GRANT)


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    conf = rows.sparkSession.conf
    if conf.get(STORE, None) != ROCKS:
        conf.set(STORE, ROCKS)
    return rows.groupBy(key).transformWithState(processor, schema, "append", "EventTime")
