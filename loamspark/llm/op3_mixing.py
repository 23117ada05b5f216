"""Mixing sources to target weights, in DataFrame functions only.

Tokens are counted per source, each source gets a target and so a rate of repetition, and each document is emitted floor(rate) times plus
one copy drawn by a seeded hash with probability equal to the fraction.

The draw depends on the id and the text; rows that have both and the source in common are numbered, and the number is part of the draw too.

Defined results: a null text has size 0 and an empty table gives an empty mix; a null source is a source of its own, last in order; rows
with equal ids (null ones too) are rows of their own and draw each for itself; ties in the order of sources do not occur, as a source is one
row; a text of any length is counted whole; a source without words has target 0 and its documents are never taken; extra columns
are carried by ``mix`` (names beginning with ``mix_`` are taken) and left out by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, doc_text, position, seeded_draw, table, text_digest, written

#: More sources than this are joined by a shuffle; up to this many are broadcast (some tens of bytes each).
BROADCAST_SOURCES = 50_000
#: Hashes of up to so many rows that occur more than once are broadcast (8 bytes each); repeats are numbered in so many slices.
BROADCAST_REPEATS, SLICES = 1_000_000, 64


def n_words(text: str = "text") -> Column:
    return F.regexp_count(doc_text(text), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    A target is min(most * size, level * weight), the level being where the targets add up to share * all sizes: that is what resharing
    the excess by weight comes to. With the sources in order of (most * size / weight), a prefix of them is capped; the level follows from
    running sums, so no loop is needed. The windows run over one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("i", F.row_number().over(order) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("i") % len(weights) + 1).cast("double"))
    cap = F.lit(most) * F.col("source_size")
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    sources = (
        sources.withColumn("cap", cap)
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_here", (F.lit(share) * F.col("all_size") - F.col("capped")) / F.col("left"))
        .withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level_here"), F.col("level_here"))).over(every))
    )
    # with all sources at their caps no level is left
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    rate = F.least(F.lit(most), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0))
    return sources.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, seed: int, *keys: Column) -> Column:
    """floor(rate), and one more where the keys' hash, as a number in [0, 1), is below the fraction."""
    draw = seeded_draw(seed, *keys) / F.lit(float(1 << 60))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def numbered(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """rows with ``out``: 0, 1, ... among rows with equal keys, 0 for most. Only rows that may be repeated are numbered, in slices, so that any number of repeats is spread."""
    mark, seen = F.xxhash64(*keys), f"{out}_mark"
    repeated = written(rows.groupBy(mark.alias(seen)).count().where("count > 1").select(seen), "repeated-rows")
    n = repeated.count()
    if not n:
        return rows.withColumn(out, F.lit(0).cast("long"))
    few = F.broadcast(repeated) if n <= BROADCAST_REPEATS else repeated
    again = rows.join(few, mark == F.col(seen), "left_semi").withColumn(f"{out}_slice", F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)))
    again = position(written(again, "repeats"), keys, f"{out}_slice", [F.lit(0)], out).drop(f"{out}_slice")
    return rows.join(few, mark == F.col(seen), "left_anti").withColumn(out, F.lit(0).cast("long")).unionByName(again)


def plan(docs: DataFrame, seed: int = 17, **targets) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs (doc_id, source, text)."""
    sized = docs.select("doc_id", "source", n_words().alias("size"), text_digest().alias("mix_text"))
    return _joined(sized, sized, seed, targets).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"))


def mix(docs: DataFrame, seed: int = 17, **targets) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    sized = docs.select("source", n_words().alias("size"))
    out = _joined(docs.withColumn("mix_text", text_digest()), sized, seed, targets, "mix_").where("mix_copies > 0")
    return out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*docs.columns)


def _joined(rows: DataFrame, sized: DataFrame, seed: int, targets: dict, prefix: str = "") -> DataFrame:
    """rows with their source's figures and mix_copies. A null source joins as one; the figures are broadcast if they are few, else joined by a shuffle that adaptive execution splits at hot sources."""
    sources = written(source_targets(sized, **targets), "mix-sources")
    sources = sources.select(F.col("source").alias("mix_source"), *[F.col(c).alias(f"{prefix}{c}") for c in ("source_size", "target", "rate")])
    few = sources.count() <= BROADCAST_SOURCES
    rows = numbered(rows, ["doc_id", "mix_text", "source"], "mix_nth")
    joined = rows.join(F.broadcast(sources) if few else sources, rows["source"].eqNullSafe(sources["mix_source"]), "inner")
    return joined.withColumn("mix_copies", copies(F.col(f"{prefix}rate"), seed, F.col("doc_id"), F.col("mix_text"), F.col("mix_nth")))


SQL = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5(coalesce(text, '')) as digest,
        row_number() over (partition by doc_id, md5(coalesce(text, '')), source) - 1 as nth from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, 2.0::double * source_size as cap,
        (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as weight from s),
o as (select *, row_number() over (order by cap / weight, source nulls last) as i, sum(source_size) over () as all_size from w),
c as (select *, coalesce(sum(cap) over (order by i rows between unbounded preceding and 1 preceding), 0) as capped,
        sum(weight) over (order by i rows between current row and unbounded following) as rest from o),
l as (select *, (1.5::double * all_size - capped) / rest as here from c),
v as (select *, max(case when cap / weight >= here then here end) over () as level from l),
t as (select source, source_size, least(cap, coalesce(level * weight, cap)) as target,
        least(2.0::double, case when source_size > 0 then least(cap, coalesce(level * weight, cap)) / source_size else 0 end) as rate from v),
j as (select doc_id, size, source_size, target, rate,
        ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || digest || ':' || nth), 1, 15))::bigint / 1152921504606846976.0::double as draw
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, size * (floor(rate) + (draw < rate - floor(rate))::int)::bigint as taken,
       (floor(rate) + (draw < rate - floor(rate))::int)::bigint as copies from j
"""


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))
