"""Ledgers: idempotent inserts, running balances, budgets and token costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def idempotent(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null in the key are all kept."""
    some = F.lit(True)
    for k in key:
        some = some & F.col(k).isNotNull()
    at = F.when(some, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).otherwise(1)
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def running_balance(rows: DataFrame, account: str, amount: Column, order: list[str]) -> DataFrame:
    return rows.withColumn("balance", F.sum(amount).over(Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def two_pools(first: Column, cost: Column) -> tuple[Column, Column]:
    """What a cost takes from the first pool (not below 0) and from the second."""
    taken = F.least(F.greatest(first, F.lit(0.0)), cost)
    return taken, cost - taken


def token_cost(fresh: Column, cached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    """Cost at prices per million tokens; cached tokens are part of the input and not more than it."""
    part = F.least(cached, fresh)
    return (F.greatest(fresh - part, F.lit(0)) * prices[0] + part * prices[1] + output * prices[2]) / 1_000_000


def as_of(facts: DataFrame, changes: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """facts with the value of the key's last change at or before the fact's time: one shuffle and a window over both, no range join."""
    both = facts.withColumn("_change", F.lit(None).cast(changes.schema[value].dataType)).withColumn("_fact", F.lit(1))
    rows = changes.select(key, ts, F.col(value).alias("_change")).withColumn("_fact", F.lit(0))
    every = both.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(ts, "_fact").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn(value, F.last("_change", True).over(w)).where("_fact = 1").drop("_change", "_fact")
