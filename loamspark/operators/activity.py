"""Activity and acceptance metrics over event logs. A rate of nothing is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_outcome(events: DataFrame, key: str, ts: str, row_id: str, is_start: Column, is_outcome: Column) -> DataFrame:
    """start_id, key, started_at, first_at, seconds: for each start event the first outcome before the key's next start (the last window is open).

    One shuffle on the key: each event carries the last start so far, instead of an interval join.
    """
    at = Window.partitionBy(key).orderBy(ts, (~is_start).cast("int"), row_id).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.where(is_start | is_outcome).withColumn("start_id", F.last(F.when(is_start, F.col(row_id)), True).over(at))
    first = F.min(F.when(is_outcome, F.col(ts)))
    jobs = marked.where("start_id is not null").groupBy(key, "start_id").agg(F.min(F.when(is_start, F.col(ts))).alias("started_at"), first.alias("first_at"))
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("first_at"))
    return jobs.select("start_id", key, "started_at", "first_at", seconds.alias("seconds"))


def rate(good: Column, bad: Column) -> Column:
    """good / (good + bad), null where there are none."""
    return F.try_divide(F.sum(good.cast("int")), F.sum((good | bad).cast("int")))


def accept_rates(rows: DataFrame, by: list[Column], accepted: Column, rejected: Column) -> DataFrame:
    """produced, accepted, rejected and accept_rate by group; pending and superseded rows only count as produced."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("produced"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(rejected).alias("rejected"),
        F.round(rate(accepted, rejected), 6).alias("accept_rate"),
    )


def week_start(ts: str) -> Column:
    """The Monday of a timestamp's week."""
    return F.date_trunc("week", F.col(ts)).cast("date")


def weekly_histogram(stamps: DataFrame, ts: str, anchor: Column, weeks: int) -> DataFrame:
    """weeks_ago, n: rows of the last ``weeks`` weeks before the anchor by age; weeks without rows are absent."""
    age = F.timestamp_diff("SECOND", F.col(ts), anchor)
    return stamps.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") < weeks * 604800)).groupBy(F.floor(F.col("age") / 604800).cast("int").alias("weeks_ago")).agg(F.count("*").alias("n"))


def dense_buckets(histogram: DataFrame, n: int) -> DataFrame:
    """bucket (oldest first), n, with empty buckets filled by 0."""
    spark = histogram.sparkSession
    every = spark.range(n).select(F.col("id").cast("int").alias("bucket"))
    found = histogram.select((F.lit(n - 1) - F.col("weeks_ago")).alias("bucket"), "n")
    return every.join(F.broadcast(found), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def rates_for(rows: DataFrame, rates: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rates with a row for each listed value, also where there is none."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return every.join(rates, key, "left")
