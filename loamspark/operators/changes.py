"""Keyed writes as joins of an old and a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and rows of old whose key new does not have."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old, and rows of new whose key old does not have."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def mark_missing(old: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """old with a column missing: whether the key is not among those touched. Null keys are left out first; rows are never deleted."""
    seen = touched.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_seen", F.lit(True))
    return old.where(F.col(key).isNotNull()).join(seen, key, "left").withColumn("missing", F.col("_seen").isNull()).drop("_seen")


def changed_by_hash(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key and status of each row of new: 'new', 'changed' or 'same' by SHA-256, so that only the first two are processed."""
    before = old.select(key, F.sha2(F.col(text), 256).alias("_old"))
    after = new.select(key, F.sha2(F.col(text), 256).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return after.join(before, key, "left").select(key, status.alias("status"))


def revived(old: DataFrame, new: DataFrame, key: list[str], mark: str = "missing") -> DataFrame:
    """References after an import: those of new with their values and not missing, also where they had been; the others of old as they were.

    old has the columns of new and ``mark``. Where new has a key twice, any one of its rows stays.
    """
    fresh = new.dropDuplicates(key).withColumn(mark, F.lit(False))
    return old.join(fresh.select(*key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))
