"""Summaries: distributions, repeats, weighted means, filter buckets, pulses, and nearest-rank quantiles at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import kept


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, before, total: how often each value is there, how many smaller ones, and how many in all. Nulls are left out.

    Rows are counted by value first. Running counts are then taken within ranges of values, and the ranges' sums added, so that no window holds a
    whole group: a range has about as many distinct values as there are of them in all over the number of shuffle partitions.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()), "ranges")  # both branches must see one cut
    sums = ranged.groupBy(*by, "_part").agg(F.sum("n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    sums = sums.withColumn("total", total).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_part").alias("_p"), "total", "_before")
    on = F.col("_part") == F.col("_p")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = ranged.withColumn("_local", local).join(sums, on)
    return met.select(*by, value, "n", (F.col("_local") + F.col("_before")).alias("before"), "total")


def quantile(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """by, n, quantile: the value at place floor(q * n) from 0, the last at most; not interpolated. Nulls are left out."""
    at = F.least(F.floor(F.lit(q) * F.col("total")), F.col("total") - 1)
    return value_counts(rows, by, value).where((F.col("before") <= at) & (at < F.col("before") + F.col("n"))).select(*by, F.col("total").alias("n"), F.col(value).alias("quantile"))


def distribution(rows: DataFrame, by: list[str], count: str, cap: int, caps: list[int]) -> DataFrame:
    """by, n, mean, median, p90, max, share_zero, share_at_cap, share_over_<c>: a summary of small counts, quantiles by nearest rank."""
    v = F.col(count)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    plain = rows.groupBy(*by).agg(
        F.count(count).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("max"), share(v == 0).alias("share_zero"), share(v >= cap).alias("share_at_cap"), *[share(v > c).alias(f"share_over_{c}") for c in caps]
    )
    middle, high = (quantile(rows, by, count, q).select(*by, F.col("quantile").alias(name)) for q, name in ((0.5, "median"), (0.9, "p90")))
    return plain.join(middle, by).join(high, by)


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, runs, mean, least, most, spread of repeated measurements."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(value).alias("runs"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.max(v) - F.min(v), 6).alias("spread"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(w * x) / sum(w), 0 without weight."""
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(0.0))


def keyed_object(key: Column, *parts: Column) -> Column:
    """A map from key to a struct of the parts, keys in order; null without rows."""
    pairs = F.array_sort(F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("key"), F.struct(*parts).alias("value")))))
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def filter_buckets(rows: DataFrame, kind: str, pending: Column, order: list[str]) -> DataFrame:
    """type, total, pending, place: all rows (type null) first, then each type there is: listed ones in their order, others by name."""
    counts = [F.count("*").alias("total"), F.count_if(pending).alias("pending")]
    types = rows.groupBy(F.col(kind).alias("type")).agg(*counts)
    listed = F.array_position(F.array(*map(F.lit, order)), F.col("type"))
    rank = F.row_number().over(Window.orderBy(F.when(listed > 0, listed).otherwise(len(order) + 1), "type"))  # a row for each type
    return rows.agg(*counts).select(F.lit(None).cast("string").alias("type"), "total", "pending", F.lit(0).alias("place")).unionByName(types.withColumn("place", rank))


def pulse(histogram: DataFrame, weeks: int, entries: Column, last_change: Column) -> DataFrame:
    """state ('moving', 'quiet' or 'unwritten'), buckets (oldest first), total, latest, peak of weekly counts (weeks_ago, n)."""
    held = histogram.where(F.col("weeks_ago").between(0, weeks - 1)).agg(F.map_from_entries(F.collect_list(F.struct("weeks_ago", "n"))).alias("m"))  # at most ``weeks`` entries
    buckets = F.transform(F.sequence(F.lit(weeks - 1), F.lit(0), F.lit(-1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("bigint")))
    total = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda s, x: s + x)
    out = held.select(buckets.alias("buckets")).withColumn("total", total)
    state = F.when(F.col("total") > 0, "moving").when((entries == 0) & last_change.isNull(), "unwritten").otherwise("quiet")
    return out.select(state.alias("state"), "buckets", "total", F.element_at("buckets", -1).alias("latest"), F.array_max("buckets").alias("peak"))


def positions(rows: DataFrame, by: str, order: list[str], out: str = "position", parts: int | None = None) -> DataFrame:
    """rows with their place from 1 within their group, in a total order. Rows are cut into ranges, and the ranges' sizes summed up before, so no window holds a whole group."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(parts, by, *order).withColumn("_part", F.spark_partition_id()), "ranges")  # both branches must see one cut
    sizes = ranged.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)))
    met = local.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return met.select(*rows.columns, (F.col("_local") + F.col("_before")).cast("int").alias(out))
