"""Paged browsing and ranked search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(column: str, order: list[str]) -> Column:
    """Place of a value in a declared order; unknown values last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def page_window(total: Column, page: int, size: int) -> tuple[Column, Column]:
    """pages (1 at least) and the page shown, which is within them."""
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("int")
    return pages, F.least(F.greatest(F.lit(page), F.lit(1)), pages)


def page(rows: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page of rows with the total: sorted by top-k, so only a page's prefix of rows is gathered. Numbers beyond the ends get the first or the last page; the count is a job of its own."""
    total = rows.count()
    number = min(max(number, 1), max(1, -(-total // size)))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", F.lit(total).cast("long"))


def ranked_aliases(rows: DataFrame, name: str, aliases: str, term: str, limit: int = 8, key: str | None = None) -> DataFrame:
    """rank and matched_alias of rows that a term finds, best first: 0 exact name, 1 its prefix, 2 exact alias, 3 its prefix, 4 a substring of either; then by name.

    Case does not matter; % and _ of the term are wildcards but for exact matches. The alias shown is an exact one, else the shortest with the prefix.
    """
    low, prefix, inside = term.lower(), f"{term}%", f"%{term}%"
    has = lambda test: F.exists(aliases, test)
    found = rows.where(F.col(name).ilike(inside) | has(lambda a: a.ilike(inside)))
    rank = F.when(F.lower(name) == low, 0).when(F.col(name).ilike(prefix), 1).when(has(lambda a: F.lower(a) == low), 2).when(has(lambda a: a.ilike(prefix)), 3).otherwise(4)
    shown = F.array_sort(F.transform(F.filter(aliases, lambda a: a.ilike(prefix)), lambda a: F.struct((F.lower(a) != low).alias("other"), F.length(a).alias("n"), a.alias("alias"))))
    return found.withColumn("rank", rank).withColumn("matched_alias", F.get(shown, 0)["alias"]).orderBy("rank", name, *([key] if key else [])).limit(limit)


def completions(rows: DataFrame, name: str, aliases: str, term: str, limit: int = 8, key: str | None = None) -> DataFrame:
    """Rows whose name or an alias contains the term, those whose name begins with it first, then by name; without a term the first by name."""
    low = term.strip().lower()
    if not low:
        return rows.orderBy(name, *([key] if key else [])).limit(limit)
    found = rows.where(F.contains(F.lower(name), F.lit(low)) | F.exists(aliases, lambda a: F.contains(F.lower(a), F.lit(low))))
    return found.orderBy((~F.startswith(F.lower(name), F.lit(low))), name, *([key] if key else [])).limit(limit)


def newest(branches: list[DataFrame], order: list[Column], limit: int) -> DataFrame:
    """The first rows of several branches together, each cut to the limit before they meet."""
    out = None
    for rows in branches:
        one = rows.orderBy(*order).limit(limit)
        out = one if out is None else out.unionByName(one)
    return out.orderBy(*order).limit(limit)


def ranked_prefix(rows: DataFrame, name: str, term: str, limit: int = 8, key: str | None = None) -> DataFrame:
    """rank 0 exact name, 1 prefix, 4 substring (case-insensitive, the term taken literally), then name."""
    low, want = F.lower(F.col(name)), F.lit(term.lower())
    rank = F.when(low == want, 0).when(F.startswith(low, want), 1).when(F.contains(low, want), 4)
    found = rows.withColumn("rank", rank).where("rank is not null")
    return found.orderBy("rank", low, *([key] if key else [])).limit(limit)


def latest_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def by_key(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row with a key, none where it is absent."""
    return rows.where(F.col(key) == value).limit(1)


#: Keys up to this many are a condition that the scan can push down; more are joined.
LISTED_KEYS = 1000


def by_keys(rows: DataFrame, key: str, values: list) -> DataFrame:
    """The rows whose key is listed; an empty list reads nothing."""
    if not values:
        return rows.limit(0)
    if len(values) <= LISTED_KEYS:
        return rows.where(F.col(key).isin(values))
    keys = rows.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{key} {rows.schema[key].dataType.simpleString()}")
    return rows.join(keys, key, "left_semi")


def streamed(rows: DataFrame, order: str):
    """The rows in order, one at a time at the driver, a partition of them in memory: for exports that must leave through one place."""
    return rows.orderBy(order).toLocalIterator(prefetchPartitions=True)
