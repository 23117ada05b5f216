"""Token ids as framed binary records, with an offset index.

A record is: length of the payload (unsigned 64 bits), masked checksum of those 8 bytes (32 bits), payload, masked checksum of the payload
(32 bits), and a line feed. The payload is doc_id (signed 64 bits), the number of ids (32 bits), the width of an id in bytes (8 bits: 2, or
4 where an id needs it), and the ids. All numbers are little-endian. The checksum is crc32, masked as (crc rotated right by 15) + 0xa282ead8,
so that checksums of data that hold checksums stay good.

Files are written by Spark's own text sink, which writes bytes as they are and ends each row with a line feed, the last record's last byte; so
writes are committed by task as usual, and a lost executor's files are written again. Texts are range-partitioned by doc_id and, within one, a
digest of the text and their place in the input (so no run of equal rows has to stay in one part), into parts of about ``PART_BYTES`` of text. A task
closes a file before a record that would bring it over ``FILE_BYTES``; a longer record is a file of its own. Files in the order of the two numbers in their
names, the part's and the file's, hold the documents in ascending order; the numbers have more digits than names are padded to, so names do not sort as
text. The index (Parquet: file, doc_id, offset, n_bytes, start, n_tokens, ids_crc32) is made by reading the files back and checking
every checksum; a shuffled reader takes its offsets from there.

Defined results: a null text is empty and so is the end id alone; a null doc_id is written as the smallest 64-bit number and comes back as
null; repeated doc_ids are records of their own, ordered by a digest of the text, and equal rows are interchangeable; a text of any length is
one record; an empty table gives no files and no rows; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, BATCH_ROWS, doc_text, parallelism, scratch, settings, table, text_buffers, written
from .tokens import default_vocabulary, encoder

NULL_ID = -(1 << 63)
#: Bytes of text that a part should hold, and bytes of records that a file does. A reader holds one file at a time.
PART_BYTES, FILE_BYTES = 2 << 30, 16 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The record without its closing line feed, which the sink adds."""
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


def unframe(content: bytes) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, bytes of the record, payload) of each record; raises ValueError on any damage."""
    view, at = memoryview(content), 0
    while at < len(view):
        head = bytes(view[at : at + 8])
        if len(head) < 8 or struct.unpack_from("<I", view, at + 8)[0] != masked(head):
            raise ValueError(f"damaged length at byte {at}")
        n = struct.unpack("<Q", head)[0]
        payload = view[at + 12 : at + 12 + n]
        if struct.unpack_from("<I", view, at + 12 + n)[0] != masked(payload) or view[at + 16 + n] != 10:
            raise ValueError(f"damaged record at byte {at}")
        yield at, n + 17, payload
        at += n + 17


def payload_of(doc_id: int, ids: np.ndarray) -> bytes:
    width = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return struct.pack("<qIB", doc_id, len(ids), width) + ids.astype(f"<u{width}").tobytes()


def parse(payload: memoryview) -> tuple[int, np.ndarray]:
    doc_id, n, width = struct.unpack_from("<qIB", payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", n, 13)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Write docs (doc_id, text) to path as record files in ascending doc_id order."""
    spark, file_bytes = docs.sparkSession, FILE_BYTES

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, held, size = encoder(vocabulary), [], 0
        for batch in batches:
            ids, counts = e.encode(*text_buffers(batch.column(1)))
            ends = np.cumsum(counts)
            for doc_id, b, n in zip(batch.column(0).to_pylist(), (ends - counts).tolist(), counts.tolist(), strict=True):
                record = frame(payload_of(doc_id, np.append(ids[b : b + n], np.uint32(end_id))))
                if held and size + len(record) + 1 > file_bytes:
                    yield _file(held)
                    held, size = [], 0
                held.append(record)
                size += len(record) + 1
        if held:
            yield _file(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), doc_text().alias("text"))
    parts = max(parallelism(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    order = ["doc_id", "digest", "place"]
    dealt = rows.withColumn("digest", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    with settings(spark, {ARROW_ROWS: str(BATCH_ROWS)}):
        whole = dealt.select("doc_id", "text").mapInArrow(files, "records binary").select(F.col("records").cast("string"))
        whole.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _file(records: list[bytes]) -> pa.RecordBatch:
    """A row that the sink makes a file of; it adds the last line feed."""
    return pa.RecordBatch.from_arrays([pa.array([b"\n".join(records)], pa.binary())], ["records"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, n_bytes, doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) of every record, checksums verified.

    A row of the scan is a file, so run it under ``settings`` that pass one row at a time to Python, as ``index`` does.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for offset, size, payload in unframe(memoryview(content.as_buffer())):
                    doc_id, ids = parse(payload)
                    rows.append((file.as_py(), offset, size, None if doc_id == NULL_ID else doc_id, len(ids), ids.astype("<u4").tobytes()))
                    held += size
                    if held > 4_000_000:
                        yield _arrow(rows)
                        rows, held = [], 0
                if rows:
                    yield _arrow(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return names.mapInArrow(records, "file string, offset long, n_bytes long, doc_id long, n_tokens long, ids binary")


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["file", "offset", "n_bytes", "doc_id", "n_tokens", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of the files at path, from reading them back."""
    with settings(spark, {ARROW_ROWS: "1"}):
        one = written(read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "token-index")
    return started(one)


def started(records: DataFrame) -> DataFrame:
    """records (file, doc_id, offset, n_bytes, n_tokens, ids_crc32) with start, the ids of all records before: in order of the two numbers in a file's name, and of offset within one."""
    numbers = [F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)", i).cast("long").alias(n) for i, n in ((1, "part"), (2, "number"))]
    files = records.groupBy("file", *numbers).agg(F.sum("n_tokens").alias("n"))

    def before(of: Window) -> Column:
        return F.coalesce(F.sum("n").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = files.groupBy("part").agg(F.sum("n").alias("n"))  # a row for some gigabytes of text
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    files = files.withColumn("in_part", before(Window.partitionBy("part").orderBy("number"))).join(parts, "part")
    files = files.select("file", (F.col("part_start") + F.col("in_part")).alias("file_start"))
    within = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    found = records.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file")
    return found.select("file", "doc_id", "offset", "n_bytes", (F.col("file_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, default_vocabulary())
    return index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
