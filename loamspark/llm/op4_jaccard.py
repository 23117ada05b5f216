"""N-gram Jaccard join over index lists with skipping by set relations.

A document's set holds its distinct word shingles (as 64-bit hashes). Equal sets are one class, found by a 128-bit key; only classes meet.

Index. Two sets of sizes a and b with Jaccard similarity of p % differ in at most H = (a + b)(100 - p) / (100 + p) shingles. The hash range is
cut into k > H parts, k the same for all sizes of a band (a power of two), so linked sets agree in k - H parts at least. A set's parts are ordered
by (number of shingles in them, hash), large ones first, and only the first H + 1 are put into index lists: linked sets meet in one of
those. A list is kept by (size, position); its blocks of one size are skipped as wholes where the sizes or the positions rule a link out
(a pair's first common part stands at position H at most in both), and members without a partner leave the list. Lists
with the same smallest member are joined to one, so a group of near copies makes a few lists and a set is sent to few. A part holds several shingles, so a passage that many documents share does not make a list by itself.

Answers. Each list is verified exactly from its members' whole sets. One member is the base: the others are held as what they lack of it and
have beyond it, and the intersections of all pairs follow from its own by those differences. A pair that shares several lists counts in the
one with the smallest number. Long lists are dealt out as pairs of blocks, of ``BLOCK`` sets or ``BLOCK_BYTES`` of them, so no task holds more than two blocks (a longer set
is a block by itself) and no pair is emitted: a
list gives each member its number of links and the smallest document of its part, and these stars are joined to components.

Components are found among classes, each known by a number of its own, so rows that share an id but no links stay apart; a component's id is the
smallest doc_id of its rows.

Defined results: null and empty texts have an empty set, no links, and are components of their own; repeated rows are documents of the
class of their text; texts of one id with different sets are rows of different classes; a null doc_id has a null component and takes no part
in linking; ties of ids go to the smaller text digest; a text of any length is one set; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, mix64, parallelism, ragged, small_batches, table, text_buffers, text_slices, word_hashes, written

#: Index entries that a bucket should hold, and entries a map task gathers before it hands them on.
BUCKET_ENTRIES, FLUSH_ENTRIES = 500_000, 2_000_000
#: Members of a block of a long list, and bytes of their sets (8 a shingle).
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Up to so many document ids or long lists (8 or 12 bytes each) are broadcast; beyond, a shuffle joins them.
BROADCAST_IDS = 2_000_000

_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and how many each text has."""
    hashes, words = word_hashes(data, starts)
    grams = hashes[n - 1 :].copy() if len(hashes) >= n else hashes[:0]
    for k in range(n - 2, -1, -1):
        grams = mix64(grams) + hashes[k : k + len(grams)]
    grams = mix64(grams)
    inside = (ragged(words) <= np.repeat(words, words) - n)[: len(grams)]
    counts = np.maximum(words - n + 1, 0)
    grams = grams[inside]
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):  # the whole sequence is the one shingle
        at, whole = (np.cumsum(words) - words)[short], mix64(words[short].astype(np.uint64) ^ _SALT)
        for k in range(n - 1):
            whole = np.where(words[short] > k, mix64(whole + hashes[np.minimum(at + k, len(hashes) - 1)]), whole)
        grams = np.insert(grams, np.cumsum(counts)[short], whole)
        counts[short] = 1
    ends = np.cumsum(counts)
    for b, e in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        grams[b:e].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[(ends - counts)[counts > 0]] = True
    total = np.concatenate([[0], np.cumsum(fresh)])
    return grams[fresh], total[ends] - total[ends - counts]


def column_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of a column of texts, some of them at once."""
    parts = [shingle_sets(*part, n) for part in text_slices(*text_buffers(texts))] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    grams, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    return grams, counts


def set_keys(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set."""
    ends, keys = np.cumsum(counts), []
    for salt in (np.uint64(1), _SALT):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(grams ^ salt))])
        keys.append(mix64(total[ends] - total[ends - counts] + counts.astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def most_different(sizes: np.ndarray, percent: int) -> np.ndarray:
    """By how many shingles linked sets can differ, from the sum of their sizes."""
    return sizes * (100 - percent) // (100 + percent)


def index_entries(grams: np.ndarray, counts: np.ndarray, keys: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """signature, key, size and position of the index entries of each set."""
    out = []
    sizes = counts.astype(np.int64)
    largest = sizes * 100 // percent
    reach = most_different(sizes + largest, percent)  # how far a set is from any that it links with
    band = np.zeros(len(sizes), np.int64)
    band[sizes > 0] = np.floor(np.log2(sizes[sizes > 0])).astype(np.int64)
    ends = np.cumsum(sizes)
    for guest in (False, True):  # a set meets sets of its own band, and smaller ones that fall into the band below
        use = (sizes > 0) & (reach > 0)
        if guest:
            use &= (band > 0) & (sizes * percent <= 100 * ((1 << band) - 1))
        use = np.flatnonzero(use)
        if not len(use):
            continue
        low = band[use] - guest
        top = ((2 << low) - 1) * 100 // percent
        parts = most_different(2 * top, percent) + 1
        size = sizes[use]
        of = np.repeat(np.arange(len(use)), size)
        token = grams[np.repeat(ends[use] - size, size) + ragged(size)]
        cell = np.repeat(np.cumsum(parts) - parts, size) + ((token >> np.uint64(32)) * parts[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # tokens are sorted, so a part's are neighbours
        width = np.diff(np.append(begin, len(cell)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(token + _SALT))])
        owner = of[begin]
        number = (cell[begin] - (np.cumsum(parts) - parts)[owner]).astype(np.uint64)
        sign = mix64(sums[begin + width] - sums[begin] + mix64(number + (low[owner].astype(np.uint64) << np.uint64(40))))
        full = np.bincount(owner, minlength=len(use))
        # parts without shingles come last in the order; where they are needed they make entries too
        want = reach[use] + 1
        empty = np.maximum(want - full, 0)
        extra = [(sign, owner, width)]
        for i in np.flatnonzero(empty):
            mine = number[np.searchsorted(owner, i) : np.searchsorted(owner, i + 1)]
            gone = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), mine)
            extra.append((mix64(mix64(gone + (low[i].astype(np.uint64) << np.uint64(40)))), np.full(len(gone), i), np.zeros(len(gone), np.int64)))
        sign, owner, width = (np.concatenate(c) for c in zip(*extra, strict=True))
        order = np.lexsort((sign, -width, owner))
        owner, sign = owner[order], sign[order]
        position = ragged(np.bincount(owner, minlength=len(use)))
        first = position < want[owner]
        owner = owner[first]
        out.append((sign[first], keys[use][owner], size[owner].astype(np.int32), position[first].astype(np.int32)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def text_key() -> Column:
    return F.xxhash64(doc_text())


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, key, key2, text_key (a hash of the text) of every row."""
    small_batches(docs.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts = column_sets(batch.column(1), n)
            arrays = [batch.column(0), pa.array(counts), *map(pa.array, set_keys(grams, counts)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "key", "key2", "text_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_text().alias("text"), text_key().alias("text_key"))
    return rows.mapInArrow(keyed, "doc_id long, n_shingles long, key long, key2 long, text_key long")


def bucketed_index(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """bucket, entries: packed index entries, a class once for each flush of a map task."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            grams, counts = column_sets(batch.column(0), n)
            held.append(index_entries(grams, counts, set_keys(grams, counts)[0], percent))
            if sum(len(h[0]) for h in held) > FLUSH_ENTRIES:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sign, key, size, position = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = (sign % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, sign, bucket))
        order = order[np.append(True, (sign[order][1:] != sign[order][:-1]) | (key[order][1:] != key[order][:-1]))] if len(order) else order
        sign, key, size, position, bucket = (x[order] for x in (sign, key, size, position, bucket))
        begin = np.searchsorted(bucket, np.arange(buckets))
        for b in np.flatnonzero(np.diff(np.append(begin, len(bucket)))).tolist():
            part = slice(begin[b], begin[b + 1] if b + 1 < buckets else None)
            blob = b"".join(x[part].tobytes() for x in (sign, key, size, position))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "entries"])

    return docs.select(doc_text().alias("text")).mapInArrow(entries, "bucket int, entries binary")


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    parts = []
    for blob in blobs:
        m = len(blob) // 24
        parts.append((np.frombuffer(blob, np.uint64, m), np.frombuffer(blob, np.int64, m, 8 * m), np.frombuffer(blob, np.int32, m, 16 * m), np.frombuffer(blob, np.int32, m, 20 * m)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def partners(size: np.ndarray, position: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a list, in order of (size, position), can link with another: blocks of one size are compared, and skipped as wholes."""
    begin = np.flatnonzero(np.append(True, size[1:] != size[:-1]))
    sizes, least, many = size[begin].astype(np.int64), position[begin], np.diff(np.append(begin, len(size)))
    keep = np.zeros(len(size), bool)
    upto = np.searchsorted(sizes, sizes * 100 // percent, "right")
    room = np.full(len(sizes), -1, np.int64)  # the last position at which a member of the block can have a partner
    for i in range(len(sizes)):
        js = np.arange(i if many[i] > 1 else i + 1, upto[i])
        h = most_different(sizes[i] + sizes[js], percent)
        js, h = js[(least[js] <= h) & (least[i] <= h)], h[(least[js] <= h) & (least[i] <= h)]
        if len(js):
            room[i] = max(room[i], h.max())
            room[js] = np.maximum(room[js], h)
    keep[:] = position <= np.repeat(room, many)
    return keep


def index_lists(index: DataFrame, percent: int) -> DataFrame:
    """list_id, key, size: the members of lists of two members or more, and how many shingles they have. A list's number is its smallest member, and lists of one number are one."""

    def gather(data: pa.Table) -> pa.Table:
        sign, key, size, position = _unpacked(data.column("entries").to_pylist())
        order = np.lexsort((key, sign))
        order = order[np.append(True, (sign[order][1:] != sign[order][:-1]) | (key[order][1:] != key[order][:-1]))]
        begin = np.flatnonzero(np.append(True, sign[order][1:] != sign[order][:-1]))
        many = np.diff(np.append(begin, len(order)))
        order = order[np.repeat(many > 1, many)]
        order = order[np.lexsort((key[order], position[order], size[order], sign[order]))]
        sign, key, size, position = sign[order], key[order], size[order], position[order]
        begin = np.flatnonzero(np.append(True, sign[1:] != sign[:-1])) if len(sign) else np.zeros(0, np.int64)
        many = np.diff(np.append(begin, len(sign)))
        pairs = begin[many == 2]
        h = most_different(size[pairs].astype(np.int64) + size[pairs + 1], percent)
        pairs = pairs[(size[pairs + 1].astype(np.int64) * percent <= 100 * size[pairs].astype(np.int64)) & (np.maximum(position[pairs], position[pairs + 1]) <= h)]
        low, high = np.minimum(key[pairs], key[pairs + 1]), np.maximum(key[pairs], key[pairs + 1])
        lists, members = [low, low], [low, high]
        sizes = [size[np.where(key[pairs] <= key[pairs + 1], pairs, pairs + 1)], size[np.where(key[pairs] <= key[pairs + 1], pairs + 1, pairs)]]
        for b, n in zip(begin[many > 2].tolist(), many[many > 2].tolist(), strict=True):
            linked = partners(size[b : b + n], position[b : b + n], percent)
            found = key[b : b + n][linked]
            if len(found) > 1:
                lists.append(np.full(len(found), found.min()))
                members.append(found)
                sizes.append(size[b : b + n][linked])
        lists, members, sizes = np.concatenate(lists), np.concatenate(members), np.concatenate(sizes)
        order = np.lexsort((members, lists))
        lists, members, sizes = lists[order], members[order], sizes[order]
        fresh = np.append(True, (lists[1:] != lists[:-1]) | (members[1:] != members[:-1])) if len(lists) else np.zeros(0, bool)
        return pa.Table.from_arrays([pa.array(lists[fresh]), pa.array(members[fresh]), pa.array(sizes[fresh])], ["list_id", "key", "size"])

    return index.groupBy("bucket").applyInArrow(gather, "list_id long, key long, size int").distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, from the differences of each set from the first."""
    base, m = sets[0], len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(base), both], [both, len(sets[1])]], np.int64)
    of, flat = np.repeat(np.arange(m), [len(s) for s in sets]), np.concatenate(sets)
    at = np.minimum(np.searchsorted(base, flat), len(base) - 1)
    hit = base[at] == flat
    held = np.bincount(of[hit], minlength=m)
    # |a & b| within the base = |base| - lacks(a) - lacks(b) + both lack
    lacks = len(base) - held
    out = (len(base) - lacks[:, None] - lacks[None, :]).astype(np.float64)
    common = np.bincount(at[hit], minlength=len(base)) < m
    columns = np.flatnonzero(common)
    place = np.full(len(base), -1)
    place[columns] = np.arange(len(columns))
    for b in range(0, len(columns), 4096):
        width = min(4096, len(columns) - b)
        lack = np.ones((m, width), np.float32)
        p = place[at]
        here = hit & (p >= b) & (p < b + width)
        lack[of[here], p[here] - b] = 0
        out += lack @ lack.T
    # beyond the base
    more, inverse, n = np.unique(flat[~hit], return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    owner, p = of[~hit][(n > 1)[inverse]], rank[inverse][(n > 1)[inverse]]
    for b in range(0, int((n > 1).sum()), 4096):
        beyond = np.zeros((m, 4096), np.float32)
        here = (p >= b) & (p < b + 4096)
        beyond[owner[here], p[here] - b] = 1
        out += beyond @ beyond.T
    return np.rint(out).astype(np.int64)


def answers(list_id: int, rows: list[dict], crossing: bool, percent: int) -> list[tuple]:
    """(node, links, lowest) for the members of a list, or of two blocks of it."""
    sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    both = intersections(sets)
    link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(link, False)
    block = np.array([r["block"] for r in rows])
    if crossing:
        link &= block[:, None] != block[None, :]
    if not link.any():
        return []
    earlier: dict[int, int] = {}
    marks = [(i, earlier.setdefault(x, len(earlier))) for i, r in enumerate(rows) for x in r["lists"] if x < list_id]
    mine = link
    if marks:  # pairs that an earlier list holds count there
        seen = np.zeros((len(rows), len(earlier)), np.float32)
        seen[tuple(np.array(marks).T)] = 1
        mine = link & (seen @ seen.T == 0)
    links = mine.astype(np.float64) @ np.array([r["copies"] for r in rows], np.float64)
    lowest = nodes = np.array([r["node"] for r in rows], np.int64)
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(lowest, np.where(link, lowest[None, :], big).min(1))
        if (new == lowest).all():
            break
        lowest = new
    return [(int(r), round(n), int(x)) for r, n, x in zip(nodes, links, lowest, strict=True) if n or x != r]


def verified(needed: DataFrame, percent: int) -> DataFrame:
    """node, links, lowest from the members of each list."""
    rows = needed.withColumn("one", F.explode("lists")).withColumn("blocks", F.col("one.blocks")).withColumn("list_id", F.col("one.list_id"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "key2"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", F.col("lists.list_id").alias("lists"), "grams")
    dealt = rows.repartition(parallelism(rows.sparkSession), "list_id", "i", "j").sortWithinPartitions("list_id", "i", "j", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["list_id"], row["i"], row["j"])
                if now != key and held:
                    out += answers(key[0], held, key[1] != key[2], percent) if len(held) > 1 else []
                    held = []
                key = now
                held.append(row)
            if len(out) > 10_000:
                yield result(out)
                out = []
        if len(held) > 1:
            out += answers(key[0], held, key[1] != key[2], percent)
        yield result(out)

    def result(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "lowest"])

    return dealt.mapInArrow(verify, "node long, links long, lowest long")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of edges (a, b) reaches. Labels spread by edges and jump to their labels' labels."""
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a")).union(edges.select("a", F.col("a").alias("to"))).union(edges.select("b", F.col("b").alias("to"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.min("to").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("label"))
        jumped = near.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.least("label", "next").alias("label"))
        new = written(jumped, "labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label < old").limit(1).count()
        labels = new
        if not moved:
            return labels.select("node", F.col("label").alias("component"))


def join_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of docs (doc_id, text); and text_key, and keeper: (doc_id, text_key) of the component's first document, null without a set or an id."""
    spark = docs.sparkSession
    sets = written(document_sets(docs, n).withColumn("row", F.monotonically_increasing_id()), "sets")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("key", "key2").agg(F.min("row").alias("node"), first, F.count("*").alias("copies"))
    classes = written(classes.withColumn("rep", F.col("first.doc_id")), "classes")
    n_entries = sets.agg(F.sum(F.col("n_shingles"))).first()[0] or 0
    buckets = max(parallelism(spark), -(-int(n_entries) * (200 - 2 * percent) // (100 + percent) // BUCKET_ENTRIES))
    lists = written(index_lists(bucketed_index(docs.where("doc_id is not null"), n, percent, buckets), percent), "lists")

    blocks = F.ceil(F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("size") * 8 / F.lit(float(BLOCK_BYTES)))).cast("int")
    long = lists.groupBy("list_id").agg(blocks.alias("blocks")).where("blocks > 1")
    long = written(long, "long-lists")  # one for each BLOCK members at most
    dealt = lists.join(F.broadcast(long) if long.count() <= BROADCAST_IDS else long, "list_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    by_key = dealt.groupBy("key").agg(F.collect_list(F.struct("list_id", "blocks")).alias("lists"))  # at most one for each entry of the set
    wanted = written(classes.drop("first").join(by_key, "key"), "wanted")
    needed = written(_with_grams(docs, wanted, n), "members")
    found = written(verified(needed, percent).groupBy("node", "lowest").agg(F.sum("links").alias("links")), "answers")
    linked = components(found.where("node <> lowest").select(F.col("node").alias("a"), F.col("lowest").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    about = classes.join(links, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    about = written(about.select(F.col("key").alias("c1"), F.col("key2").alias("c2"), "component", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("c_links")), "classes-linked")
    firsts = about.groupBy("component").agg(F.min("first").alias("keeper"))
    about = about.drop("first").join(firsts, "component")
    some: Column = F.col("n_shingles") > 0
    joined = sets.join(about, some & F.col("doc_id").isNotNull() & (sets["key"] == about["c1"]) & (sets["key2"] == about["c2"]), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("keeper.doc_id", "doc_id").alias("component_id"), F.coalesce("c_links", F.lit(0)).cast("long").alias("n_links"), "text_key", "keeper")


def _with_grams(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """wanted with the sets of its representatives, made again from their texts."""
    ids = wanted.select("rep").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), doc_text().alias("text")).join(ids, "rep")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts = column_sets(batch.column(1), n)
            ends = np.concatenate([[0], 8 * np.cumsum(counts)]).astype(np.int64)
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(grams)])
            arrays = [batch.column(0), *map(pa.array, set_keys(grams, counts)), blobs.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "key", "key2", "grams"])

    sets = rows.mapInArrow(made, "rep long, key long, key2 long, grams binary")
    return sets.join(wanted, ["rep", "key", "key2"]).dropDuplicates(["key", "key2"])


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")
