"""Intervals, orderings and settlements over histories of keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str, at: str, starts: Column, ends: Column) -> DataFrame:
    """The starting rows, each with ended: the time of the user's next ending row, null while open."""
    ahead = Window.partitionBy(user).orderBy(at).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return events.withColumn("ended", F.min(F.when(ends, F.col(at))).over(ahead)).where(starts)


def in_no_session(events: DataFrame, user: str, at: str, starts: Column, ends: Column, anchor: Column, facts: Column) -> DataFrame:
    """The rows of facts that lie in no session of their user, bounds included; open sessions end at the anchor.

    A row lies in one if the latest end among those started by then has not passed: two windows over one shuffle, no join.
    """
    ahead = Window.partitionBy(user).orderBy(at).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = Window.partitionBy(user).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ended = events.withColumn("_end", F.when(starts, F.coalesce(F.min(F.when(ends, F.col(at))).over(ahead), anchor)))
    return ended.withColumn("_open_to", F.max("_end").over(so_far)).where(facts & (F.col("_open_to").isNull() | (F.col("_open_to") < F.col(at)))).drop("_end", "_open_to")


def after_session(facts: DataFrame, closed: DataFrame, user: str, at: str, hours: int) -> DataFrame:
    """The facts at most some hours after a session of their user ended, not at that very time. closed has the user and ended."""
    bounds = closed.where("ended is not null").select(F.col(user).alias("_user"), "ended").distinct()
    near = (F.col(user) == F.col("_user")) & (F.col(at) > F.col("ended")) & (F.col(at) <= F.col("ended") + F.expr(f"interval {hours} hours"))
    return facts.join(bounds, near, "left_semi")


def stale(rows: DataFrame, key: str, order: str, period: str) -> DataFrame:
    """rows with stale: whether an earlier row of the key had the same or a later period."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("stale", F.coalesce(F.col(period) <= F.max(period).over(before), F.lit(False)))


def settled(rows: DataFrame, key: str, at: str, tie: str, terminal: Column) -> DataFrame:
    """The first terminal row of each key: later ones change nothing."""
    return rows.where(terminal).groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(at, tie)).alias("r")).select("r.*")


def admitted(queued: DataFrame, running: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """queued with admitted: whether the key's running rows leave a place for it, oldest first."""
    counts = running.groupBy(key).agg(F.count("*").alias("_running"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return queued.withColumn("_place", place).join(counts, key, "left").withColumn("admitted", F.col("_place") <= limit - F.coalesce("_running", F.lit(0))).drop("_place", "_running")


def next_position(rows: DataFrame, parent: str, position: str) -> DataFrame:
    """parent, next_position: the place after the last child; 0 where no child has one."""
    return rows.groupBy(parent).agg((F.coalesce(F.max(position), F.lit(-1)) + 1).alias("next_position"))


def latest_ratio(rows: DataFrame, key: str, order: str, n: int, over: Column, by: Column, default: float) -> DataFrame:
    """key, ratio: sum(over) / sum(by) of the latest n rows of the key whose by is positive; the default where over sums to 0."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    sums = rows.where(by > 0).withColumn("_at", at).where(F.col("_at") <= n).groupBy(key).agg(F.sum(over).alias("_o"), F.sum(by).alias("_b"))
    return sums.select(key, F.when(F.col("_o") > 0, F.col("_o") / F.col("_b")).otherwise(default).cast("double").alias("ratio"))


def folded(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """key, members (distinct, in order), times: repeated proposals of a key become one row."""
    return rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(member)).alias("members"), F.count("*").alias("times"))


def settled_or_stopped(rows: DataFrame, key: str, at: str, tie: str, final: Column, ceiling: Column) -> DataFrame:
    """The row that settles each key: its first final one; without one, its last that only reached a ceiling, which a later one may still replace."""
    order = F.struct(at, tie)
    whole = F.struct(*rows.columns)
    ends = rows.groupBy(key).agg(F.min_by(whole, F.when(final, order)).alias("f"), F.max_by(whole, F.when(ceiling, order)).alias("c"))
    return ends.select(F.coalesce("f", "c").alias("r")).where("r is not null").select("r.*")
