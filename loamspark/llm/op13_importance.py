"""Importance resampling towards a target: hashed n-gram counts of a raw and of a target corpus weigh each raw document, and a seeded draw keeps the highest.

Lower-cased words (A-Z only) are runs of digits, letters and characters beyond ASCII. A document's features are its runs of one to
three words, joined by a space; a feature's bucket is its crc32 modulo ``BUCKETS``. The way is an external sort and count:

1. ``streams`` writes every document's buckets as packed uint16 streams with the documents' offsets, some megabytes a row (Parquet in the shared
   folder, so a lost executor's part is written again);
2. ``counts`` sorts each stream and run-length encodes it, and adds up the runs of a bucket: a task sends at most one row a bucket;
3. ``weights`` gathers the gains of the buckets (``BUCKETS`` numbers, whatever the corpus) along the streams and adds them up between the offsets.

The checksum of a run of words comes from those of its words: appending n bytes to a text multiplies its checksum by a power of x that depends on n alone, and
four tables of 256 entries hold that product for each n. So no feature becomes an object, and no byte is looked at more than twice.

Ranks are counted by ranges of (score, doc_id): no window runs over all rows.

Defined results: a null or empty text has no features and weight 0, and is never drawn; a null doc_id is hashed as the empty text and comes first among
equal scores; rows with repeated ids count each for itself, have the same noise, and equal rows are interchangeable; a text of any length is one run of a
stream; an empty table gives no rows, an empty target counts as no features; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, BATCH_ROWS, doc_text, parallelism, ragged, settings, table, text_buffers, text_slices, written

BUCKETS, GRAMS, SEED = 10_000, 3, 42
#: Documents with fewer words are not drawn; the share that is drawn, in per cent.
LEAST_WORDS, PER_CENT = 20, 5
#: A row of the table of streams is closed when its stream has so many bytes.
STREAM_BYTES = 4 << 20
#: Words up to so many bytes go through the tables a byte at a time, longer ones through zlib.
SHORT = 48
STREAM = "doc_id array<long>, n_words array<long>, offsets array<long>, stream binary"


def _byte_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, np.uint32(0xEDB88320) ^ (crc >> 1), crc >> 1).astype(np.uint32)
    return crc


BYTE = _byte_table()
SPACE = np.uint32(zlib.crc32(b" "))


class Appended:
    """What a checksum becomes when n more bytes follow: for each n met so far, tables by the checksum's four bytes."""

    def __init__(self):
        self.row = np.full(SHORT + 2, -1, np.int64)
        self.tables = np.zeros((0, 4, 256), np.uint32)

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        """The 32 single-bit checksums, each followed by n zero bytes: squares of the map of one byte."""
        bits = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        out, step = bits.copy(), BYTE[bits & 255] ^ (bits >> 8)
        while n:
            if n & 1:
                out = Appended._apply(step, out)
            step, n = Appended._apply(step, step), n >> 1
        return out

    @staticmethod
    def _apply(image: np.ndarray, to: np.ndarray) -> np.ndarray:
        on = (to[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        return np.bitwise_xor.reduce(np.where(on == 1, image[None, :], np.uint32(0)), axis=1).astype(np.uint32)

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        if len(n) and int(n.max()) >= len(self.row):
            long = n >= len(self.row)
            out = np.empty(len(n), np.uint32)
            out[~long] = self(crc[~long], n[~long])
            for size in np.unique(n[long]).tolist():
                own = n == size
                out[own] = self._apply(self._powers(size), crc[own])
            return out
        new = np.unique(n)
        new = new[self.row[new] < 0]
        if len(new):
            values, made = np.arange(256, dtype=np.uint32), []
            for size in new.tolist():
                image = self._powers(size)
                made.append([self._apply(image, values << np.uint32(8 * k)) for k in range(4)])
            self.row[new] = len(self.tables) + np.arange(len(new))
            self.tables = np.concatenate([self.tables, np.array(made, np.uint32)])
        flat, at = self.tables.reshape(-1), self.row[n] * 1024
        return flat[at + (crc & 255)] ^ flat[at + 256 + ((crc >> 8) & 255)] ^ flat[at + 512 + ((crc >> 16) & 255)] ^ flat[at + 768 + (crc >> 24)]


_appended = Appended()


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased, and where words begin and end; no word runs over the end of a text."""
    kind = np.zeros(256, bool)
    kind[48:58] = kind[97:123] = kind[128:] = True
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = kind[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1 : len(data)]
    end[:-1] &= ~inside[1:] | edge[1 : len(data)]
    return low, np.flatnonzero(begin), np.flatnonzero(end) + 1


def _word_sums(low: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of each word: one byte of all words that still have one at a time, longest words first."""
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    at, left = begin[order], size[order]
    long = int((left > SHORT).sum())
    out = np.empty(len(size), np.uint32)
    for w, b, n in zip(order[:long].tolist(), at[:long].tolist(), left[:long].tolist(), strict=True):
        out[w] = zlib.crc32(low[b : b + n])
    order, at, left = order[long:], at[long:], left[long:]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    more = np.searchsorted(-left, -np.arange(1, SHORT + 1), "right")  # how many have a k-th byte
    for k, n in enumerate(more.tolist()):
        if not n:
            break
        crc[:n] = BYTE[(crc[:n] ^ low[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out[order] = ~crc
    return out


def buckets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of each text, text by text, as uint16, and how many words each text has."""
    parts = [_buckets(*part) for part in text_slices(data, starts)]
    if not parts:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    return np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts])


def _buckets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_texts = len(starts) - 1
    low, begin, end = _words(data, starts) if len(data) else (data, np.zeros(0, np.int64), np.zeros(0, np.int64))
    words = np.diff(np.searchsorted(begin, starts))
    if not len(begin):
        return np.zeros(0, np.uint16), words
    size = end - begin
    own = _word_sums(low, begin, size)
    spaced = _appended(np.full(len(own), SPACE, np.uint32), size) ^ own  # of a space and the word
    place, left = ragged(words), np.repeat(np.cumsum(words), words) - np.arange(len(own))
    first = np.repeat(np.cumsum(n_features(words)) - n_features(words), words)
    out, crc = np.empty(int(n_features(words).sum()), np.uint16), own
    before = np.zeros(n_texts, np.int64)  # features of the text with fewer words
    for n in range(GRAMS):
        if n:
            crc = _appended(crc[:-1], size[n:] + 1) ^ spaced[n:] if len(crc) > 1 else crc[:0]
        if not len(crc):
            break
        have = np.flatnonzero(left[: len(crc)] > n)  # runs that end within their text
        out[first[have] + np.repeat(before, words)[have] + place[have]] = crc[have] % np.uint32(BUCKETS)
        before += np.maximum(words - n, 0)
    return out, words


def n_features(words: np.ndarray) -> np.ndarray:
    return sum(np.maximum(words - n, 0) for n in range(GRAMS))


def streams(rows: DataFrame, label: str) -> DataFrame:
    """Packed bucket streams of rows (doc_id, text), written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        for batch in batches:
            stream, words = buckets(*text_buffers(batch.column(1)))
            held.append((batch.column(0), words, stream))
            if sum(s.nbytes for _, _, s in held) >= STREAM_BYTES:
                yield _row(held)
                held = []
        if held:
            yield _row(held)

    with settings(rows.sparkSession, {ARROW_ROWS: str(BATCH_ROWS)}):
        return written(rows.select(F.col("doc_id").cast("long"), doc_text().alias("text")).mapInArrow(pack, STREAM), label, {"compression": "zstd"})


def _row(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    words = np.concatenate([w for _, w, _ in held])
    ids = pa.concat_arrays([i.cast(pa.int64()) for i, _, _ in held]).to_pylist()
    offsets = np.concatenate([[0], np.cumsum(n_features(words))])
    stream = b"".join(s.astype("<u2").tobytes() for _, _, s in held)
    columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([stream], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "offsets", "stream"])


def counts(packed: DataFrame) -> DataFrame:
    """bucket, n: how often each bucket occurs in streams."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"), kind="stable")
                heads = np.flatnonzero(np.diff(ordered, prepend=np.uint16(0xFFFF)))
                total[ordered[heads]] += np.diff(np.append(heads, len(ordered)))
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(total[have])], ["bucket", "n"])

    return packed.select("stream").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from counts of two corpora: BUCKETS numbers, whatever their size."""
    s, t = (np.zeros(BUCKETS) for _ in range(2))
    for total, found in ((s, raw), (t, target)):
        for r in found.collect():
            total[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document of packed streams."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, stream in zip(*batch.columns, strict=True):
                at = offsets.values.to_numpy()
                total = np.zeros(len(at) - 1, np.int64)
                have = np.flatnonzero(np.diff(at))
                if len(have):
                    total[have] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), "<u2")], at[have])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(np.diff(at)), pa.array(total)], ["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and, for the drawn per_cent, rank of every row of docs (doc_id, text); target has a column text."""
    spark = docs.sparkSession
    packed = streams(docs, "bucket-streams")
    aim = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "target-streams")
    with settings(spark, {ARROW_ROWS: "4"}):
        gain = gains(counts(packed), counts(aim))
        scored = written(weights(packed, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    return ranked(scored, per_cent)


def ranked(scored: DataFrame, per_cent: int) -> DataFrame:
    """scored with rank: 1, 2, ... for the per_cent of rows with enough words that score highest, ties to the smaller doc_id."""
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    able = scored.where(F.col("n_words") >= LEAST_WORDS).withColumn("tie", F.monotonically_increasing_id())
    dealt = able.repartitionByRange(parallelism(spark), *order, F.asc("tie")).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "score-ranges")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n_part"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("n_before"), F.sum("n_part").over(Window.partitionBy()).alias("n_all"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order, F.asc("tie"))) + F.col("n_before")
    drawn = dealt.join(F.broadcast(parts), "part").withColumn("place", place)
    rank = F.when(F.col("place") <= F.floor(F.col("n_all") * per_cent / 100), F.col("place")).cast("long").alias("rank")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    few = scored.where(F.col("n_words") < LEAST_WORDS).select(*names, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*names, rank).unionByName(few)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
