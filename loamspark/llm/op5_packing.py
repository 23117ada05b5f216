"""Packing documents into sequences of bounded length by minimum bin slack.

Only the number of pieces of each length matters for the plan, and lengths are bounded by the capacity; so the plan is made from a table of
at most ``capacity`` counts, whatever the size of the input. For each bin the longest piece left is taken, and a subset-sum dynamic program
over the lengths left, on the bits of one integer, finds the fullest combination that still fits. That combination is removed as often as
the counts allow, so a plan is a short list of (combination, how often). Pieces are numbered within their length and look up their place.

A hot length (of a group of copies, say) is numbered in salted slices, with the slices' counts summed up before.

Defined results: a null text is empty, and an empty text is the end id alone; rows with equal ids are packed each; a text of any length is
encoded whole and cut into full pieces and a rest; an empty table gives no rows; extra columns are not read by ``pieces`` and are kept by ``pack``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, small_batches, table, text_buffers, written
from .tokens import default_vocabulary, encoder

CAPACITY = 4096
#: Pieces of one length that are numbered in one slice.
SLICE_ROWS = 50_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers). Only documents longer than the capacity are cut."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            ids, counts = e.encode(*text_buffers(batch.column(1)))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
            counts = counts + 1
            ends = np.cumsum(counts)
            n = -(-counts // capacity)
            of = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, counts[of] - start)
            at = 4 * np.concatenate([[0], np.cumsum(length)])
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), binary.cast(pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_text().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def fullest(counts: np.ndarray, room: int) -> Counter:
    """The combination of pieces (length: how many) that fills the room most, not using more pieces than there are."""
    bits, goal, mask, steps = 1, 1 << room, (1 << (room + 1)) - 1, []
    for length in (np.flatnonzero(counts[: room + 1])[::-1]).tolist():
        left, k = min(int(counts[length]), room // length), 1
        while left and not bits & goal:
            k = min(k, left)
            steps.append((length, k, bits))
            bits |= (bits << (k * length)) & mask
            left, k = left - k, 2 * k
        if bits & goal:
            break
    at, chosen = bits.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += k
            at -= k * length
    return chosen


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """(combination, how often) for bins of the capacity. counts[length] pieces are there; none is longer than the capacity."""
    left, out = np.asarray(counts, np.int64).copy(), []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        bin_ = fullest(left, capacity - longest)
        left[longest] += 1
        bin_[longest] += 1
        times = min(int(left[length]) // k for length, k in bin_.items())
        for length, k in bin_.items():
            left[length] -= times * k
        out.append((bin_, times))
    return out


def places(planned: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """The plan by length: pieces first..first+times*each-1 of that length stand in bins base.., each to a bin, from offset on."""
    used, base, rows = Counter(), 0, []
    for bin_, times in planned:
        offset = 0
        for length in sorted(bin_, reverse=True):
            rows.append((length, used[length], bin_[length], base, offset))
            used[length] += times * bin_[length]
            offset += length * bin_[length]
        base += times
    names = ("length", "first", "each", "base", "offset")
    return dict(zip(names, np.array(sorted(rows), np.int64).reshape(-1, 5).T, strict=True))


def pack(rows: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """rows (with a column length from 1 to the capacity) with sequence_id and offset added. keys tell rows apart."""
    counts = np.zeros(capacity + 1, np.int64)
    by_length = rows.groupBy("length").agg(F.count("*").alias("n_length"))
    for length, n in by_length.collect():  # at most ``capacity`` rows
        counts[length] = n
    where = places(plan(counts, capacity))

    draw: Column = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.ceil(F.col("n_length") / SLICE_ROWS))
    salted = rows.join(F.broadcast(by_length), "length").withColumn("salt", draw).drop("n_length")  # at most ``capacity`` rows
    slices = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*keys)) - 1
    numbered = salted.withColumn("local", local).join(slices, ["length", "salt"])
    numbered = numbered.select(*rows.columns, (F.col("local") + F.col("n_before")).alias("number"))

    big = int(counts.sum()) + 1
    kept = rows.columns
    start = where["length"] * big + where["first"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
            at = np.searchsorted(start, length * big + number, "right") - 1
            within = number - where["first"][at]
            bin_, nth = within // where["each"][at], within % where["each"][at]
            arrays = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(where["base"][at] + bin_), pa.array(where["offset"][at] + nth * length)], [*kept, "sequence_id", "offset"])

    schema = rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return numbered.mapInArrow(look_up, schema)


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, vocabulary, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = pack(written(cut, "pieces"), ["doc_id", "piece", "ids_crc32"], capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), default_vocabulary())
