"""Feeds of events: replay from an id with a bounded backlog, grants that come late, and pages indexed batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import vectors

#: Events of a universe that a reader who was away can still get.
BACKLOG = 300


def replayed(events: DataFrame, universe: str, event_id: str, since: DataFrame, backlog: int = BACKLOG) -> DataFrame:
    """The events that each reader (since: reader, universe, since_id) has not seen, oldest first by event_id: of the universe's latest ``backlog`` those above since_id; a null since_id gets all of them.

    A stream goes on from there by its checkpoint; this is what a new reader starts with.
    """
    newest = F.row_number().over(Window.partitionBy(universe).orderBy(F.desc(event_id)))
    held = events.withColumn("_n", newest).where(F.col("_n") <= backlog).drop("_n")
    return since.join(held, universe).where(F.col("since_id").isNull() | (F.col(event_id) > F.col("since_id"))).drop("since_id").orderBy("reader", event_id)


GRANT = "account string, event_id string, period long, granted double"


def grants(events: DataFrame, late: str = "30 days") -> DataFrame:
    """account, event_id, period, granted: what each event (account, event_id, ts, period, amount) grants. A replayed id is left out; a period that is not later than the last one applied grants 0 and changes nothing.

    On a stream the last period of an account is its state, and ids are remembered within the watermark; events of a batch apply in order of ts,
    then id. A table gives the same by a window.
    """
    rows = events.select(F.col("account").cast("string"), F.col("event_id").cast("string"), "ts", F.col("period").cast("long"), F.col("amount").cast("double"))
    if not events.isStreaming:
        once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("ts"))).where("_n = 1")
        before = F.max("period").over(Window.partitionBy("account").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
        late_one = F.col("period") <= before
        return once.select("account", "event_id", "period", F.when(late_one, 0.0).otherwise(F.col("amount")).alias("granted"))

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"], kind="stable")
            granted = []
            for period, amount in zip(frame["period"], frame["amount"], strict=True):
                fresh = last is None or period > last
                granted.append(float(amount) if fresh else 0.0)
                last = int(period) if fresh else last
            yield frame.assign(granted=granted)[["account", "event_id", "period", "granted"]]
        if last is not None:
            state.update((last,))

    unique = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return unique.groupBy("account").applyInPandasWithState(apply, GRANT, "last long", "append", GroupStateTimeout.NoTimeout)


def indexer(load: Callable[[], DataFrame], store: Callable[[DataFrame], None], chunk: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that indexes pages (url, page_updated_at, ...): unchanged ones are skipped, others replaced by their chunks. A batch that is run again changes nothing."""

    def index(pages: DataFrame, _: int) -> None:
        store(vectors.reindexed(load(), pages, chunk(pages)))

    return index
