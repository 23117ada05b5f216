"""What the operators of this subpackage share: tables, scratch space and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows a Python task gets at once; texts can be long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """How many groups to deal work into: as many as shuffles have partitions here."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared checkpoint folder of the session. Only a local master (as in tests) may have none: one is made for it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='loamspark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, options: dict | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Have Python tasks get so few rows at once, from now on. The setting is read when a plan is run, so it stays for frames that the caller runs; a lower one is kept."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the jobs that run within; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def crc32_mod(key: Column, n: int) -> Column:
    """crc32 of a key's decimal text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def seeded_draw(seed: int, *keys: Column) -> Column:
    """A number from 0 to 2**60 - 1 that depends on the seed and the keys alone, in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def position(rows: DataFrame, group: list[str], slice_: str, order: list[str | Column], out: str) -> DataFrame:
    """The 0-based place of each row among the rows of its group, in order of (slice, order). No window runs over more than a slice: the slices' counts are summed up before."""
    counts = rows.groupBy(*group, slice_).agg(F.count("*").alias("n_slice"))
    before = Window.partitionBy(*group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("n_before", F.coalesce(F.sum("n_slice").over(before), F.lit(0))).drop("n_slice")
    local = F.row_number().over(Window.partitionBy(*group, slice_).orderBy(*order)) - 1
    ranked, keys = rows.withColumn("local_place", local), [*group, slice_]
    on = ranked[slice_].eqNullSafe(counts[slice_])
    for k in keys[:-1]:
        on = on & ranked[k].eqNullSafe(counts[k])
    return ranked.join(counts, on).select(*[ranked[c] for c in rows.columns], (F.col("local_place") + F.col("n_before")).alias(out))


def text_digest(name: str = "text") -> Column:
    """A digest that tells texts apart; null counts as empty."""
    return F.md5(doc_text(name).cast("binary"))


def doc_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text starts (one more entry than texts)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


#: Bytes of text that are hashed at once, which takes some forty times as much memory; a longer text is hashed by itself.
SLICE_BYTES = 1 << 19


def text_slices(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts of a buffer in runs of about SLICE_BYTES, each as a buffer of its own."""
    n = len(starts) - 1
    cuts = np.unique(np.append(np.searchsorted(starts[:n], np.arange(0, len(data), SLICE_BYTES)), [0, n])).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, 1 << 20)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text with A-Z lower-cased, and how many words each text has.

    The hash of a word is the polynomial over its bytes, taken from prefix sums of the whole buffer, so no word becomes a Python object.
    """
    n = len(data)
    counts = np.zeros(len(starts) - 1, np.int64)
    if not n:
        return np.zeros(0, np.uint64), counts
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[starts] = True  # no word runs over the end of a text
    inside = ~space
    begin = inside.copy()
    begin[1:] &= space[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= space[1:] | edge[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    low = data.astype(np.uint64)
    low[(data >= 65) & (data <= 90)] += np.uint64(32)
    low += np.uint64(1)
    power, inverse = power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(low) * power[:n], out=total[1:])
    hashes = mix64((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    counts[:] = np.diff(np.searchsorted(begin, starts))
    return hashes, counts


def column_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of a column of texts, some of them at once."""
    parts = [word_hashes(*part) for part in text_slices(*text_buffers(texts))] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    hashes, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    return hashes, counts


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
