"""Tables of a folder of Parquet files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan dealt evenly to as many tasks as run at once, or as the scan has splits if these are more, where much is done with each row.

    A split is a range of a file's bytes, and only the one with a row group's middle gets its rows: a large file of one row group is one task however many splits it has.
    """
    return scan.repartition(max(scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Have Python tasks get so few rows at once, from now on, so that what they hold does not grow with the rows of a task. A plan reads the setting when it is run, so it stays; a lower one is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextmanager
def few_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Have Python tasks of the jobs that run within get so few rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(rows))
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the session's shared checkpoint folder and read it again. Only a local master (as in tests) may have none: one is made for it."""
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='loamspark-')}"
        df.sparkSession.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
