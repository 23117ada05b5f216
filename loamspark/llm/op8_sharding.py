"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are ranked within their source in a seeded random order; a row's fractional rank is (rank + 1/2) / (rows of its source). All rows are
ordered by fractional rank and cut into shards whose counts differ by one at most, so each shard holds the mixture of sources.

No window runs over a whole source: ranks are counted within slices of the hash (then of the fractional rank) and the slices' counts are
summed up before, so a source with a third of all rows is spread like the rest.

The law is ``rows``: every row counts as one, whatever its text, so rows of equal texts are rows like others and may stand in different shards.
The draw depends on the keys, of which a digest of the text is one, so groups of copies are spread too. Rows that agree in all keys get places
next to each other and are interchangeable.

Defined results: a null text has size 8; a null source is a source of its own; rows with equal ids are told apart by their texts; ties of the
draw go by the keys; a text of any length is one row; an empty table gives no rows; extra columns are carried by ``interleave`` (names beginning
with ``deal_`` are taken) and not read by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import position, seeded_draw, table, text_digest

#: Rows that one slice should hold.
SLICE_ROWS = 50_000


def _spread(n: int) -> int:
    return max(16, -(-n // SLICE_ROWS))


def interleave(rows: DataFrame, shards: int = 24, seed: int = 8, keys: tuple[str, ...] = ("doc_id", "text_digest"), stratum: str = "source") -> DataFrame:
    """rows with ``shard`` and ``slot`` (from 0 within the shard) added. The keys seed the draw and order rows whose draws are equal."""
    if not keys:
        raise ValueError("rows are told apart by keys")
    n = rows.count()
    slices = _spread(n)
    dealt = rows.withColumn("deal_draw", seeded_draw(seed, *[F.col(k) for k in keys]))
    dealt = dealt.withColumn("deal_slice", F.floor(F.col("deal_draw") / F.lit(float(1 << 60)) * slices))  # grows with the draw
    ranked = position(dealt, [stratum], "deal_slice", ["deal_draw", *keys], "deal_rank")
    sizes = rows.groupBy(F.col(stratum).alias("deal_stratum")).agg(F.count("*").alias("deal_n"))
    ranked = ranked.join(sizes, ranked[stratum].eqNullSafe(sizes["deal_stratum"])).drop("deal_stratum")
    ranked = ranked.withColumn("deal_fraction", (F.col("deal_rank") + 0.5) / F.col("deal_n")).withColumn("deal_part", F.floor(F.col("deal_fraction") * slices))
    placed = position(ranked, [], "deal_part", ["deal_fraction", F.col(stratum).asc_nulls_last(), "deal_rank"], "deal_place")
    shard = F.expr(f"deal_place * {shards} div {max(n, 1)}").cast("int")
    first = F.expr(f"(deal_shard * {max(n, 1)} + {shards - 1}) div {shards}")
    out = placed.withColumn("deal_shard", shard).withColumn("deal_slot", (F.col("deal_place") - first).cast("long"))
    return out.select(*rows.columns, F.col("deal_shard").alias("shard"), F.col("deal_slot").alias("slot"))


#: The columns that SQL can express; it has no crc32, so the query is held against this and plain crc32 in tests.
SQL = """
with r as (select doc_id, source, coalesce(strlen(text), 0)::bigint + 8 as size, md5(coalesce(text, '')) as digest from documents),
k as (select *, ('0x' || substr(md5('8:' || coalesce(doc_id::varchar, '') || ':' || digest), 1, 15))::bigint as draw from r),
s as (select *, row_number() over (partition by source order by draw, doc_id nulls first, digest) - 1 as rank, count(*) over (partition by source) as n_source, count(*) over () as n from k),
f as (select *, (rank + 0.5::double) / n_source as fraction from s),
p as (select *, row_number() over (order by fraction, source nulls last, rank) - 1 as place from f)
select doc_id, size, (place * 24 // n)::int as shard, place - ((place * 24 // n) * n + 23) // 24 as slot from p
"""


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        text_digest().alias("text_digest"),
    )
    out = interleave(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
