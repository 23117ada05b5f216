"""Collections of vector points as tables: checks, scans, counts, idempotent upserts and deletes by payload."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("Cosine", "Euclid", "Dot", "Manhattan")


def matching(payload: Mapping[str, object], without: Mapping[str, object] | None = None) -> Column:
    """Whether a point has all the payload's values and none of those it must not have."""
    out = F.lit(True)
    for k, v in payload.items():
        out = out & (F.col(k) == F.lit(v))
    for k, v in (without or {}).items():
        out = out & ~F.coalesce(F.col(k) == F.lit(v), F.lit(False))
    return out


def scrolled(points: DataFrame, payload: Mapping[str, object], limit: int) -> DataFrame:
    """Up to ``limit`` points with a payload, unscored, in order of their id."""
    return points.where(matching(payload)).orderBy("id").limit(limit)


def counted(points: DataFrame, payload: Mapping[str, object], without: Mapping[str, object] | None = None) -> DataFrame:
    """n: the exact number of points with a payload."""
    return points.where(matching(payload, without)).agg(F.count("*").alias("n"))


def upserted(points: DataFrame, new: DataFrame) -> DataFrame:
    """The points with new ones in place of those of their id; without new points, the same. Of new points with one id any one stays."""
    return points.join(new.select("id"), "id", "left_anti").unionByName(new.dropDuplicates(["id"]))


def deleted(points: DataFrame, keys: DataFrame) -> DataFrame:
    """The points whose payload has none of the combinations in ``keys`` (such as universe, source and url)."""
    return points.join(keys.distinct(), keys.columns, "left_anti")


def ready(points: DataFrame | None, empty: DataFrame, size: int, metric: str = "Cosine", recreate: bool = False) -> DataFrame:
    """The collection if it is there and its vectors have the size, an empty one otherwise; with another size an error, or an empty one where it may be made anew."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if points is None:
        return empty
    other = points.where(F.size("vector") != size).limit(1).count()
    if other and not recreate:
        raise ValueError(f"collection holds vectors of another size than {size}")
    return empty if other else points


def reindexed(points: DataFrame, pages: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("url",), stamp: str = "page_updated_at") -> DataFrame:
    """The points after pages are indexed: pages whose stamp the stored points have already are skipped, the others' points are replaced by their chunks.

    Running it twice changes nothing. pages has keys and stamp, chunks has the columns of points. Nulls are values like others.
    """
    held = points.select(*keys, stamp).distinct()
    todo = _met(pages.select(*keys, stamp).distinct(), held, [*keys, stamp], "left_anti").select(*keys).distinct()
    return _met(points, todo, keys, "left_anti").unionByName(_met(chunks, todo, keys, "left_semi").select(points.columns))


def _met(rows: DataFrame, others: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """rows that others have (left_semi) or do not have (left_anti); a null is a value like others."""
    other = others.select(*[F.col(c).alias(f"_{c}") for c in on])
    return rows.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]), how)


def unfinished(documents: DataFrame, settled: DataFrame, key: str) -> DataFrame:
    """What a resumed job still has to do: documents whose key no settled row has."""
    return documents.join(settled.select(key).distinct(), key, "left_anti")
