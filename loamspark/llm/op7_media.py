"""Media columns of progressive JPEG files: written with their payload, read back, decoded to RGB tensors and described.

``store`` packs each payload losslessly into the coefficients of one progressive file (see ``jpeg``) and writes a table of binary columns to
the shared folder. ``tensors`` reads such a table (or any table of 8-bit progressive files): scans are accumulated into coefficient arrays,
inverse-transformed with numpy, chroma is upsampled, and the full-resolution RGB samples come out as a binary column of height x width x 3.
``described`` gives digests and features instead, so that wide tensors need not leave the task.

Each picture is a row of its own and nothing is shuffled; a task holds one Arrow batch of rows at a time.

Defined results: a null text is empty; an empty text is one block row of padding; rows with equal ids or texts are described each, equal
texts alike; a picture is about square, so a text of any length that Spark can hold stays within the format's 65,535 lines, and a task holds a whole
picture; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import doc_text, scratch, small_batches, table, text_buffers

#: Payloads are padded with bytes 255, which no UTF-8 text holds, up to a positive multiple of this.
UNIT_BYTES = 576


def padded(text: np.ndarray) -> np.ndarray:
    size = max(1, -(-len(text) // UNIT_BYTES)) * UNIT_BYTES
    out = np.full(size, 255, np.uint8)
    out[: len(text)] = text
    return out


def store(docs: DataFrame, label: str = "media") -> DataFrame:
    """doc_id, media: a table of progressive files that carry the texts of docs, written to the shared folder and opened again."""
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffers(batch.column(1))
            files = [jpeg.encode(padded(data[b:e])) for b, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_text().alias("text"))
    path = scratch(spark, label)
    rows.mapInArrow(encode, "doc_id long, media binary").write.option("compression", "zstd").parquet(path)
    return spark.read.schema("doc_id long, media binary").parquet(path)


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width, rgb (height x width x 3 bytes) of a table of progressive files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, file in zip(batch.column(0), batch.column(1), strict=True):  # a tensor may be large, so each leaves on its own
                picture = jpeg.Picture(file.as_py())
                values = [[doc_id.as_py()], [picture.height], [picture.width], [picture.rgb().tobytes()]]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(decode, "doc_id long, height int, width int, rgb binary")


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and a 64-bit average hash: whether each of 8 x 8 areas is brighter than the picture."""
    height, width = rgb.shape[:2]
    means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) / (height * width)
    grey = rgb.sum(2, dtype=np.int32)
    rows, columns = np.arange(8) * height // 8, np.arange(8) * width // 8
    areas = np.add.reduceat(np.add.reduceat(grey, rows, 0), columns, 1)
    size = np.outer(np.diff(np.append(rows, height)), np.diff(np.append(columns, width)))
    bright = areas * (height * width) > int(grey.sum(dtype=np.int64)) * size
    return f"{width}x{height} {means[0]:.3f} {means[1]:.3f} {means[2]:.3f} {np.packbits(bright).tobytes().hex()}"


COLUMNS = {
    "doc_id": (pa.int64(), "long"),
    "n_bytes": (pa.int64(), "long"),
    "payload_bytes": (pa.int64(), "long"),
    "payload_sha256": (pa.string(), "string"),
    "tail_crc32": (pa.int64(), "long"),
    "media_bytes": (pa.int64(), "long"),
    "media_sha256": (pa.string(), "string"),
    "feature": (pa.string(), "string"),
}


def described(media: DataFrame) -> DataFrame:
    """What the stored files hold: payload and file digests, and features of the decoded tensors."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                picture = jpeg.Picture(file)
                payload = picture.payload()
                digests = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest()
                rows.append((doc_id, len(payload.rstrip(b"\xff")), len(payload), *digests, feature(picture.rgb())))
            columns = zip(*rows, strict=True) if rows else [[] for _ in COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (k, _) in zip(columns, COLUMNS.values(), strict=True)], list(COLUMNS))

    return media.select("doc_id", "media").mapInArrow(describe, ", ".join(f"{c} {k}" for c, (_, k) in COLUMNS.items()))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(store(table(spark, sf_dir, "documents")))
