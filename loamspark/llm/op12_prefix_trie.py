"""The trie of conversations by their turns: every distinct sequence of first turns is a node, found by prefix-doubling naming.

A turn's name is a number for its role and text. A block of 2 to the power j turns, at a multiple of that length, is named by the pair of its halves'
names; so all blocks have names after as many join rounds as the longest conversation's length has bits. A prefix of d turns is, by the
bits of d from the highest down, a chain of such blocks: in round j every prefix whose length is an odd multiple of 2 to the power j is named by the pair of
the prefix before it and one block. Each round halves its rows on the way up and doubles them on the way down, so all rounds together
move twice as many rows as there are turns. Names are dense: distinct pairs are counted by partition. Equal names of equal lengths mean equal prefixes,
and nodes are groups of them.

What a subtree sums up is summed over conversations: each node's share is put on its smallest member, the shares of a conversation are added from its
end, and a node takes the sums of its members at its own depth; so no level of the trie waits for another.

Rows are numbers from the first step on: texts are shuffled once, to order the turns (a conversation of any length is ordered in slices of turn numbers), and
are known by their digest afterwards. The digest of the ids that end in a node is one pass over sorted rows that holds a hash state, not the ids.

Defined results: rows without conv_id take no part; null roles and texts are empty; turns with equal numbers come in the order of role and text, and repeated
rows are turns of their own; the base of a negative id is nearer to zero, as ``%`` has it in SQL; a text of any length is one turn; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, crc32_mod, small_batches, table, written

#: Turn numbers, or depths, that one window runs over at most.
SLICE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_key (a digest of role and text), n_chars of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    # null turns come first: a slice of their own
    rows = rows.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))))
    place = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    light = written(rows.select("conv_id", "slice", place.cast("long").alias("pos"), key.alias("turn_key"), F.length("text").cast("long").alias("n_chars")), "turns")
    sizes = light.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("before", before).where("before > 0").drop("n")
    return light.join(later, ["conv_id", "slice"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_key", "n_chars")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations as (conv_id, n_turns), and their turns as (conv_id, pos, turn_key, n_chars): the first h turns of the base, an id's hundred, then an id's own after its first h."""
    h = crc32_mod(F.col("conv_id"), most)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(bases, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "rebuilt-sizes")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "h").join(heads, "base").where("pos < h").select("conv_id", "pos", "turn_key", "n_chars")
    rest = turns.where(F.col("pos") >= h).join(convs.select("conv_id", "h", "taken"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "n_chars")
    return convs.select("conv_id", "n_turns"), written(first.unionByName(rest), "rebuilt")


def named(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """rows with a dense name, from 0, for each distinct combination of keys."""
    distinct = written(rows.select(*keys).distinct().withColumn("at", F.monotonically_increasing_id()), f"{label}-keys")
    part = F.shiftright("at", 33)
    parts = distinct.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    names = distinct.withColumn("part", part).join(F.broadcast(parts), "part")
    names = names.select(*keys, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("name"))
    return written(rows.join(names, keys).drop(*[k for k in keys if k in ("left", "right", "turn_key")]), label)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, name of every prefix of every conversation; equal (depth, name) are equal prefixes. The root is depth 0, name 0."""
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    blocks = [named(turns.select("conv_id", "pos", "turn_key"), ["turn_key"], "block-0")]
    while 2 << (len(blocks) - 1) <= longest:
        even = F.col("pos").bitwiseAND(1) == 0
        halves = [F.max(F.when(side, F.col("name"))).alias(to) for side, to in ((even, "left"), (~even, "right"))]
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("pos", 1).alias("pos")).agg(*halves).where("left is not null and right is not null")
        blocks.append(named(pairs, ["left", "right"], f"block-{len(blocks)}"))
    zero = F.lit(0).cast("long")
    found = convs.select("conv_id", zero.alias("depth"), zero.alias("name"))
    for j in range(len(blocks) - 1, -1, -1):
        next_block = blocks[j].where(F.col("pos").bitwiseAND(1) == 0).select("conv_id", F.shiftleft("pos", j).alias("depth"), F.col("name").alias("right"))
        longer = found.withColumnRenamed("name", "left").join(next_block, ["conv_id", "depth"])
        longer = longer.withColumn("depth", F.col("depth") + (1 << j))
        found = found.unionByName(named(longer, ["depth", "left", "right"], f"prefix-{j}").select("conv_id", "depth", "name"))
    return written(found, "prefixes")


def _suffix_sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """names of rows (conv_id, depth, *names) summed over a conversation's rows from each depth on; windows run over slices."""
    rows = rows.withColumn("slice", F.floor(F.col("depth") / SLICE))
    within = Window.partitionBy("conv_id", "slice").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("conv_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "slice").agg(*[F.sum(n).alias(n) for n in names])
    totals = totals.select("conv_id", "slice", *[F.sum(n).over(after).alias(f"{n}_after") for n in names]).where(" or ".join(f"{n}_after > 0" for n in names))
    summed = rows.select("conv_id", "depth", "name", "slice", *[F.sum(n).over(within).alias(n) for n in names])
    return summed.join(totals, ["conv_id", "slice"], "left").select("conv_id", "depth", "name", *[(F.col(n) + F.coalesce(f"{n}_after", F.lit(0))).alias(n) for n in names])


def _ends(members: DataFrame) -> DataFrame:
    """depth, name, ends_sha256 of members (depth, name, conv_id): the digest of each node's ids in ascending order, joined by commas."""
    schema = "depth long, name long, ends_sha256 string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for depth, name, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, name) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, name), hashlib.sha256(str(conv_id).encode())
                else:
                    state.update(f",{conv_id}".encode())
            yield _rows(out)
        yield _rows([] if at is None else [(*at, state.hexdigest())])

    key = ["depth", "name"]
    return members.repartition(*key).sortWithinPartitions(*key, "conv_id").select(*key, "conv_id").mapInArrow(hashed, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "name": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every node of the trie of conversations (conv_id, n_turns) with turns (conv_id, pos, turn_key, n_chars).

    conv_id is a node's smallest member, which tells it apart from the others of its depth.
    """
    small_batches(turns.sparkSession, 32 * BATCH_ROWS)
    key = ["depth", "name"]
    found = prefixes(convs, turns)
    nodes = found.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    above = found.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_chars")
    nodes = written(nodes.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left"), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, key, "left").fillna(0, ["n_children", "n_chars"]), "nodes-with-children")
    share = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    shares = found.join(share, ["conv_id", "depth"], "left").fillna(0, ["saved_tokens", "n_leaves"])
    sums = _suffix_sums(shares, ["saved_tokens", "n_leaves"]).groupBy(*key).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = _ends(found.join(convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(sums, key).join(ends, key, "left").join(parents, ["depth", "parent"], "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(ordered_turns(table(spark, sf_dir, "conversations"))))


#: A crc32 by its definition, a bit at a time, over the digits of an id; prefixes as lists.
SQL = """
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, length(coalesce(text, '')) as n
  from conversations where conv_id is not null),
listed as (select conv_id, list({'k': k, 'n': n} order by pos) as turns from own group by conv_id),
sized as (
  select conv_id, turns, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) % 6 as h
  from listed),
whole as (
  select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns from sized c left join listed b on b.conv_id = c.base),
prefixes as (
  select conv_id, d as depth, list_transform(turns[1:d], lambda x: x.k) as node, list_transform(turns[1:d - 1], lambda x: x.k) as above,
    case when d > 0 then turns[d].n else 0 end as n, len(turns) = d as ends
  from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from whole)),
nodes as (
  select node, depth, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, any_value(n) as n,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefixes group by node, depth),
kids as (select depth - 1 as depth, above as node, count(*) as n_children from nodes where depth > 0 group by all),
full_nodes as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.depth = n.depth and k.node = n.node),
sums as (
  select p.node, p.depth, sum((u.n_convs - 1) * u.n) as saved_tokens, sum((u.n_children = 0)::bigint) as n_leaves
  from full_nodes u join prefixes p on p.conv_id = u.conv_id and p.depth <= u.depth group by p.node, p.depth)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from full_nodes n join sums s on s.depth = n.depth and s.node = n.node
left join nodes p on p.depth = n.depth - 1 and p.node = n.above and n.depth > 0
"""
