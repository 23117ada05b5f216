"""Removal of long repeated byte strings: every byte that a string of ``LENGTH`` bytes covers which starts anywhere else too, in the same text or another.

Strings that repeat are found in suffix arrays over places, not over all positions, and these are dealt out by content:

1. Of each LENGTH bytes in a row, the ``GRAM`` bytes with the least hash among them are an anchor. Equal strings have their anchors at equal offsets, so every
   repetition shows up as two anchors with equal grams; about two positions of LENGTH - GRAM are anchors. What can matter of an anchor's surroundings is its
   segment: LENGTH - GRAM bytes before it and LENGTH bytes from it on.
2. Anchors whose gram occurs once go. Of those whose whole segment occurs again, all of it is repeated, which needs no text, only counts of digests.
3. The other segments of a gram are sorted together, one of each kind: once by what follows the anchor, once by what goes before it, backwards. Sorting is
   deep-shallow: a multikey sort, a word of eight bytes at a time, down to ``SHALLOW`` bytes, and then a blind trie (branching bits only, one comparison for an
   insertion) for each group that still has a common prefix. Neighbours' common prefixes give classes of every depth; an anchor's outermost repeated strings
   are those whose two classes, before and after it, hold another segment.
4. The spans found around a text's anchors are put together, and what is left of it is hashed.

Exact copies are one text throughout. A gram with more than ``GROUP_ROWS`` different segments is not sorted in one task: the digests of its segments'
strings, LENGTH - GRAM + 1 at most each, are counted by Spark instead, which gives the same result. Texts are shuffled once, into a bucketed table in the shared folder that
both later steps read in place.

Defined results: a null text is empty; nothing of a text of fewer than LENGTH bytes is removed; exact copies of longer ones go whole, all of them; rows with repeated or
null ids are rows each; a text of any length is hashed in pieces of ``PIECE`` bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, BATCH_ROWS, doc_text, mix64, parallelism, power_tables, scratch, settings, table, text_buffers, written

LENGTH, GRAM = 400, 160
#: Bytes that the multikey sort looks at before blind tries take over.
SHALLOW = 24
#: Different segments of one gram that one task sorts.
GROUP_ROWS = 50_000
#: Segments that are sorted at once, with those of the group that is open; bytes that are hashed at once.
SORT_ROWS, PIECE = 8192, 1 << 19
EMPTY = hashlib.sha256(b"").hexdigest()
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each width entries in a row."""
    n = len(x) - width + 1
    blocks = np.pad(x, (0, -len(x) % width), mode="edge").reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).reshape(-1)
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Where the anchors of a buffer of texts are, and a 64-bit hash of each one's gram. Texts of fewer than length bytes have none."""
    flags, hashes = np.zeros(len(data), bool), []
    width = length - gram + 1
    done = 0  # anchors before this place have their hash
    for a in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[a : a + PIECE + length - 1]
        power, inverse = power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power[: len(part)], out=total[1:])
        n = len(part) - gram + 1
        gram_hash = mix64((total[gram:] - total[:n]) * inverse[:n])
        rank = (gram_hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        edge = np.zeros(len(part), np.int32)
        lo, hi = np.searchsorted(starts, [a + 1, a + len(part)])
        edge[starts[lo:hi] - a] = 1
        edge = np.cumsum(edge)
        least = _sliding(rank, width, np.minimum)
        least[edge[length - 1 :] != edge[: len(edge) - length + 1]] = 0  # not within one text
        chosen = _sliding(np.pad(least, width - 1), width, np.maximum) == rank
        at = np.flatnonzero(chosen)
        new = at[(at + a >= done) | ~flags[at + a]]
        flags[a + new] = True
        hashes.append((a + new, gram_hash[new]))
        done = a + len(part)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, found = (np.concatenate(c) for c in zip(*hashes, strict=True))
    order = np.argsort(at, kind="stable")
    return at[order], found[order]


def _blind_trie(keys: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of byte strings of equal length, and the bytes each has in common with the one before it, from a trie that stores the branching bits alone."""
    width, numbers = 8 * len(keys[0]), [int.from_bytes(k, "big") for k in keys]
    bits, sides, same = [], [], {}
    root = ~0
    for i in range(1, len(keys)):
        key, node = keys[i], root
        while node >= 0:
            b = bits[node]
            node = sides[node][(key[b >> 3] >> (7 - (b & 7))) & 1]
        differ = numbers[i] ^ numbers[~node]
        if not differ:
            same.setdefault(~node, []).append(i)
            continue
        at, above, side, node = width - differ.bit_length(), None, 0, root
        while node >= 0 and bits[node] < at:
            b = bits[node]
            above, side = node, (key[b >> 3] >> (7 - (b & 7))) & 1
            node = sides[node][side]
        bits.append(at)
        sides.append([node, ~i] if (key[at >> 3] >> (7 - (at & 7))) & 1 else [~i, node])
        if above is None:
            root = len(bits) - 1
        else:
            sides[above][side] = len(bits) - 1
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node < 0:
            order += [~node, *same.get(~node, ())]
            common += [depth] + [width >> 3] * len(same.get(~node, ()))
        else:
            stack += [(sides[node][1], bits[node] >> 3), (sides[node][0], depth)]
    return order, common


def deep_shallow(strings: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the rows of a byte matrix within ascending groups: the order, and how many bytes each row has in common with the one before it (-1: the first of its group)."""
    n, width = strings.shape
    words = np.ascontiguousarray(strings).view(">u8")
    order, run = np.arange(n), group
    common = np.where(np.diff(group, prepend=group[:1] - 1) != 0, -1, width)
    for j in range(min(shallow // 8, words.shape[1])):
        word = words[order, j].astype(np.uint64)
        moved = np.lexsort((word, run))
        order, word = order[moved], word[moved]
        differ = np.zeros(n, np.uint64)
        differ[1:] = word[1:] ^ word[:-1]
        new = (differ != 0) & (common == width)
        # leading zero bytes of what differs
        zero = sum((differ[new] < (np.uint64(1) << np.uint64(8 * k))).astype(np.int64) for k in range(1, 8))
        common[new] = 8 * j + zero
        run = np.cumsum(common != width)
        if not (common == width).any():
            return order, common
    open_ = common == width
    head = np.flatnonzero(open_ & ~np.append(False, open_[:-1])) - 1
    tail = np.flatnonzero(open_ & ~np.append(open_[1:], False)) + 1
    for a, b in zip(head.tolist(), tail.tolist(), strict=True):
        rows = order[a:b]
        own, shared = _blind_trie([strings[r].tobytes() for r in rows.tolist()])
        order[a:b] = rows[own]
        common[a + 1 : b] = shared[1:]
    return order, common


def outermost(group: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the most and the fewest bytes before its anchor with which a string of the given length occurs in another segment of its group at the same place (-1: none does).

    before (backwards) and after are byte matrices, filled up with zeros beyond n_before and n_after bytes.
    """
    n = len(group)
    most, fewest = np.full(n, -1), np.full(n, -1)
    sorted_ = [deep_shallow(m, group) for m in (before, after)]
    size = np.bincount(np.cumsum(np.diff(group, prepend=group[:1] - 1) != 0) - 1)
    of = np.repeat(size, size)
    two = np.flatnonzero((of == 2) & (np.diff(group, prepend=group[:1] - 1) == 0))
    if len(two):
        common = [np.minimum(c[two], np.minimum(k[two], k[two - 1])) for (_, c), k in zip(sorted_, (n_before, n_after), strict=True)]
        good = common[0] + common[1] >= length
        for rows in (two[good], two[good] - 1):
            most[rows], fewest[rows] = common[0][good], np.maximum(length - common[1][good], 0)
    many = np.flatnonzero(of > 2)
    for d in range(int(n_before[many].max()) + 1 if len(many) else 0):
        able = many[(n_before[many] >= d) & (n_after[many] >= length - d)]
        if len(able) < 2:
            continue
        classes = []
        for (order, common), depth in zip(sorted_, (d, length - d), strict=True):
            place = np.empty(n, np.int64)
            place[order] = np.cumsum(common < max(depth, 0))
            classes.append(place[able])
        both = classes[0] * (n + 1) + classes[1]
        ordered = np.argsort(both, kind="stable")
        equal = both[ordered[1:]] == both[ordered[:-1]]
        hit = able[ordered[np.append(equal, False) | np.append(False, equal)]]
        most[hit] = d
        fewest[hit] = np.where(fewest[hit] < 0, d, fewest[hit])
    return most, fewest


def _key() -> list[Column]:
    """Two halves of a text's digest."""
    digest = F.md5(doc_text())
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"d{i + 1}") for i in range(2)]


KEY = ["d1", "d2"]


def distinct_texts(docs: DataFrame, least: int) -> DataFrame:
    """d1, d2, text, copies of the texts of at least so many bytes, in buckets of (d1, d2)."""
    spark = docs.sparkSession
    long = docs.select(doc_text().alias("text")).where(F.octet_length("text") >= least)
    texts = long.select(*_key(), "text").groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"loamspark_{uuid.uuid4().hex}"
    n = min(parallelism(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    writer = texts.write.format("parquet").option("path", scratch(spark, "texts")).option("compression", "zstd")
    writer.bucketBy(n, *KEY).saveAsTable(name)
    return spark.table(name)


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """gram, segment (hashes), d1, d2, pos, copies (2 at most) of all anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffers(batch.column(0))
            at, hashes = anchors(data, starts, length, gram)
            text = np.searchsorted(starts, at, "right") - 1
            begin = np.maximum(at - (length - gram), starts[text])
            end = np.minimum(at + length, starts[text + 1])
            raw = data.tobytes()
            digests = b"".join([hashlib.md5(raw[b:e] + n.to_bytes(4, "little")).digest()[:8] for b, e, n in zip(begin.tolist(), end.tolist(), (at - begin).tolist(), strict=True)])
            columns = [hashes.view(np.int64), np.frombuffer(digests, np.int64), *(c.to_numpy()[text] for c in batch.columns[1:3]), at - starts[text], batch.column(3).to_numpy()[text]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "segment", "d1", "d2", "pos", "copies"])

    few = texts.select("text", *KEY, F.least("copies", F.lit(2)).cast("long").alias("copies"))
    return few.mapInArrow(rows, "gram long, segment long, d1 long, d2 long, pos long, copies long")


SEGMENT = "gram long, d1 long, d2 long, pos long, whole boolean, before binary, after binary"


def _segments(members: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    """members (gram, d1, d2, pos, whole) with the bytes before (backwards) and after their anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for d1, d2, text, own in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw, d1, d2 = text.as_buffer().to_pybytes(), d1.as_py(), d2.as_py()
                for m in own.as_py():
                    p = m["pos"]
                    held.append((m["gram"], d1, d2, p, m["whole"], raw[max(0, p - length + gram) : p][::-1], raw[p : p + length]))
                    size += 2 * length
                    if size > 4 << 20:
                        yield _table(held, SEGMENT)
                        held, size = [], 0
            yield _table(held, SEGMENT)

    by_text = members.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "pos", "whole")).alias("own"))
    return by_text.join(texts.select(*KEY, "text"), KEY).select(*KEY, "text", "own").mapInArrow(cut, SEGMENT)


_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, k in enumerate(kinds)], list(names))


FOUND = "d1 long, d2 long, pos long, before long, after long"


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows filled up with zeros, and their lengths."""
    data, starts = text_buffers(column)
    size = np.diff(starts)
    out = np.zeros((len(size), -(-width // 8) * 8), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - np.repeat(starts[:-1], size)] = data
    return out, size


def _sorted_groups(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        columns = {n: part.column(n).chunk(0) for n in part.column_names}
        before, after = _matrix(columns["before"], length - gram), _matrix(columns["after"], length)
        most, fewest = outermost(columns["gram"].to_numpy(), *before, *after, length)
        hit = np.flatnonzero((most >= 0) & ~columns["whole"].to_numpy(zero_copy_only=False))
        own = [columns[n].to_numpy()[hit] for n in ("d1", "d2", "pos")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*own, most[hit], length - fewest[hit])], ["d1", "d2", "pos", "before", "after"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= SORT_ROWS:
                part = pa.Table.from_batches(held)
                grams = part.column("gram").to_numpy()
                cut = int(np.searchsorted(grams, grams[-1]))  # the last group may go on
                if cut:
                    yield found(part.slice(0, cut))
                    held = part.slice(cut).to_batches()
                    n -= cut
        if n:
            yield found(pa.Table.from_batches(held))

    return groups


def _counted_strings(segments: DataFrame, length: int) -> DataFrame:
    """FOUND of segments, from counts of digests of all their strings: for grams with too many segments to sort in one task."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for gram_hash, d1, d2, pos, whole, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, n = before[::-1] + after, len(before)
                for d in range(max(0, length - len(after)), n + 1):
                    # with the anchor's gram and offset: strings meet as they do when sorted, and none meets itself by another anchor
                    digest = hashlib.md5(struct.pack("<qq", gram_hash, d) + raw[n - d : n - d + length]).digest()
                    held.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), d1, d2, pos, whole, d))
                if len(held) > 50_000:
                    yield _table(held, schema)
                    held = []
            yield _table(held, schema)

    schema = "w1 long, w2 long, d1 long, d2 long, pos long, whole boolean, before long"
    each = written(segments.mapInArrow(strings, schema), "strings")
    again = each.groupBy("w1", "w2").count().where("count > 1").drop("count")
    hits = each.where("not whole").join(again, ["w1", "w2"]).groupBy(*KEY, "pos")
    return hits.agg(F.max("before").alias("before"), (F.lit(length) - F.min("before")).alias("after"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """d1, d2, pos, before, after: around pos of a text (d1, d2, text, copies), so many bytes before and from there on are repeated, cut at the text's ends. Texts with copies are left out, as all of them is."""
    spark = texts.sparkSession
    with settings(spark, {ARROW_ROWS: str(BATCH_ROWS)}):
        every = written(_anchor_rows(texts, length, gram), "anchors", {"compression": "zstd"})
    kinds = every.groupBy("gram").agg(F.sum("copies").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"))
    # written before they are joined, so that the join has exchanges of its own and a hot gram's rows can be split
    again = written(kinds.where("n > 1").select("gram", (F.col("low") < F.col("high")).alias("mixed")), "repeated-grams")
    again = written(every.join(again, "gram"), "repeated-anchors", {"compression": "zstd"})
    mixed = again.where("mixed")
    classes = mixed.groupBy("gram", "segment").agg(F.sum("copies").alias("n"), F.min(F.struct(*KEY, "pos")).alias("first"))
    classes = written(classes.select("gram", "segment", (F.col("n") > 1).alias("whole"), "first.*"), "segment-classes")
    sizes = classes.groupBy("gram").agg(F.count("*").alias("n_classes"), F.min("whole").alias("settled"))
    sizes = written(sizes.where("not settled").select("gram", (F.col("n_classes") > group_rows).alias("large")), "gram-sizes")
    members = written(classes.join(sizes, "gram").drop("segment"), "members")
    parts = [again.where("not mixed and copies < 2"), mixed.where("copies < 2").join(classes.where("whole").select("gram", "segment"), ["gram", "segment"])]
    spans = [p.select(*KEY, "pos", F.lit(length - gram).cast("long").alias("before"), F.lit(length).cast("long").alias("after")) for p in parts]
    ordered = _segments(members.where("not large"), texts, length, gram).repartition(parallelism(spark), "gram").sortWithinPartitions("gram")
    with settings(spark, {ARROW_ROWS: "256"}):
        spans.append(written(ordered.mapInArrow(_sorted_groups(length, gram), FOUND), "spans"))
    large = members.where("large")
    if not large.isEmpty():
        with settings(spark, {ARROW_ROWS: "64"}):
            many = written(_segments(large, texts, length, gram), "large-segments", {"compression": "zstd"})
            spans.append(written(_counted_strings(many, length), "large-spans"))
    found = spans[0]
    for s in spans[1:]:
        found = found.unionByName(s)
    return found


def _kept(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d1, d2, text, own in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw, own = memoryview(text.as_buffer()), own.values
                pos, before, after = (own.field(i).to_numpy() for i in range(3))
                start, end = np.maximum(pos - before, 0), np.minimum(pos + after, len(raw))
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(end[order])
                head = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                start, end = start[head], reach[np.append(head[1:], len(reach)) - 1]
                state, at = hashlib.sha256(), 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    state.update(raw[at:a])
                    at = b
                state.update(raw[at:])
                out.append((d1.as_py(), d2.as_py(), int((end - start).sum()), len(start), start.tolist(), end.tolist(), state.hexdigest()))
            names, kinds = ["d1", "d2", "n_removed", "n_spans", "starts", "ends", "kept_sha256"], [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return kept


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, starts and ends of the removed runs (bytes from, and up to), kept_sha256 of every row of docs (doc_id, text)."""
    texts = distinct_texts(docs, length)
    by_text = repeated_spans(texts, length, gram, group_rows).groupBy(*KEY).agg(F.collect_list(F.struct("pos", "before", "after")).alias("own"))
    joined = texts.where("copies = 1").join(by_text, KEY).select(*KEY, "text", "own")
    schema = "d1 long, d2 long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept_sha256 string"
    with settings(docs.sparkSession, {ARROW_ROWS: "64"}):
        partly = written(joined.mapInArrow(_kept(length), schema), "kept", {"compression": "zstd"})
    wholly = texts.where("copies > 1").select(*KEY, *[F.lit(None).cast(t).alias(n) for n, t in (("n_removed", "long"), ("n_spans", "long"), ("starts", "array<long>"), ("ends", "array<long>"), ("kept_sha256", "string"))], F.lit(True).alias("whole"))
    known = partly.withColumn("whole", F.lit(False)).unionByName(wholly)
    rows = docs.select("doc_id", *_key(), F.octet_length(doc_text()).cast("long").alias("n_bytes"), F.sha2(doc_text(), 256).alias("own_sha"))
    none = F.array().cast("array<long>")
    out = rows.join(known, KEY, "left")

    def either(name: str, whole: Column, else_: Column) -> Column:
        return F.when(F.col("whole"), whole).otherwise(F.coalesce(name, else_)).alias(name)

    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        either("n_removed", F.col("n_bytes"), zero),
        either("n_spans", F.lit(1).cast("long"), zero),
        either("starts", F.array(zero), none),
        either("ends", F.array("n_bytes"), none),
        either("kept_sha256", F.lit(EMPTY), F.col("own_sha")),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
