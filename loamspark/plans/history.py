"""Queries over histories. A signup opens a session that the next error ends; orders are renewals and jobs; turns are children of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text as fn
from ..functions.words import EXCERPT_STOP
from ..operators import history as op
from ..sources import table

QUERIES, SQL = {}, {}
_S = "s as (select user_id, ts as started, (select min(e.ts) from events e where e.event_type = 'error' and e.user_id = x.user_id and e.ts >= x.ts) as ended from events x where event_type = 'signup')"
#: Open sessions end here.
ANCHOR = "2100-01-01 00:00:00"


def kind(name):
    return F.col("event_type") == name


QUERIES["views_in_no_session"] = lambda spark, d: op.in_no_session(table(spark, d, "events"), "user_id", "ts", kind("signup"), kind("error"), F.lit(ANCHOR).cast("timestamp_ntz"), kind("view")).select("event_id", "user_id")
SQL["views_in_no_session"] = f"with {_S} select event_id, user_id from events v where event_type = 'view' and not exists (select 1 from s where s.user_id = v.user_id and v.ts >= s.started and v.ts <= coalesce(s.ended, timestamp '{ANCHOR}'))"


def purchases_after_session(spark, d):
    events = table(spark, d, "events")
    closed = op.sessions(events, "user_id", "ts", kind("signup"), kind("error"))
    return op.after_session(events.where(kind("purchase")), closed, "user_id", "ts", 168).select("event_id", "user_id")


QUERIES["purchases_after_session"] = purchases_after_session
SQL["purchases_after_session"] = f"with {_S} select event_id, user_id from events p where event_type = 'purchase' and exists (select 1 from s where s.user_id = p.user_id and p.ts > s.ended and p.ts <= s.ended + interval 168 hours)"
QUERIES["stale_renewals"] = lambda spark, d: op.stale(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate").select("o_orderkey", F.col("stale").cast("int").alias("stale"))
SQL["stale_renewals"] = "select o_orderkey, coalesce(o_orderdate <= max(o_orderdate) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), false)::int as stale from orders"
QUERIES["settled_users"] = lambda spark, d: op.settled(table(spark, d, "events"), "user_id", "ts", "event_id", kind("purchase") | kind("error")).select("user_id", "event_id", "event_type")
SQL["settled_users"] = "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('purchase', 'error')) where n = 1"


def admitted_orders(spark, d):
    orders = table(spark, d, "orders")
    return op.admitted(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'P'"), "o_custkey", "o_orderkey", 3).select("o_orderkey", F.col("admitted").cast("int").alias("admitted"))


QUERIES["admitted_orders"] = admitted_orders
SQL["admitted_orders"] = """
select o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey) <= 3 - (select count(*) from orders r where r.o_orderstatus = 'P' and r.o_custkey = q.o_custkey))::int as admitted
from orders q where o_orderstatus = 'O'"""
QUERIES["next_turns"] = lambda spark, d: op.next_position(table(spark, d, "conversations"), "conv_id", "turn")
SQL["next_turns"] = "select conv_id, max(turn) + 1 as next_position from conversations group by conv_id"
QUERIES["recent_unit_prices"] = lambda spark, d: op.latest_ratio(
    table(spark, d, "lineitem").withColumn("line", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")), "l_suppkey", "line", 20, F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)"), 0.25
).select("l_suppkey", F.round("ratio", 3).alias("ratio"))
SQL["recent_unit_prices"] = """
select l_suppkey, round(sum(l_extendedprice::decimal(18, 2))::double / sum(l_quantity::decimal(18, 2))::double, 3) as ratio
from (select *, row_number() over (partition by l_suppkey order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_extendedprice desc, l_quantity desc) as n from lineitem where l_quantity > 0) where n <= 20 group by l_suppkey"""
QUERIES["folded_names"] = lambda spark, d: op.folded(table(spark, d, "part"), F.lower("p_name"), "p_brand").select("key", F.array_join("members", "|").alias("members"), "times")
SQL["folded_names"] = "select lower(p_name) as key, string_agg(distinct p_brand, '|' order by p_brand) as members, count(*) as times from part group by lower(p_name)"
QUERIES["nested_turns"] = lambda spark, d: (
    table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns")).select("conv_id", F.array_join("turns.role", ",").alias("roles"))
)
SQL["nested_turns"] = "select conv_id, string_agg(role, ',' order by turn, role) as roles from conversations group by conv_id"
QUERIES["point_ids"] = lambda spark, d: table(spark, d, "pages").select("page_id", keys.name_uuid(F.col("url"), F.col("page_id").cast("string")).alias("point_id"))
_SHA = f"sha1(from_hex('{keys.NAMESPACE}') || encode(url || chr(0) || page_id))"
SQL["point_ids"] = f"""
select page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (array['8', '9', 'a', 'b'])[(('0x' || h[17:17])::int % 4) + 1] || h[18:20] || '-' || h[21:32] as point_id from (select page_id, {_SHA} as h from pages)"""
QUERIES["source_fingerprints"] = lambda spark, d: (
    table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ids")).select("o_custkey", keys.fingerprint(F.col("ids"), "v1", "model").alias("fingerprint"))
)
SQL["source_fingerprints"] = "select o_custkey, sha256(string_agg(o_orderkey::varchar, chr(1) order by o_orderkey::varchar) || chr(1) || 'v1' || chr(1) || 'model') as fingerprint from orders group by o_custkey"


def keywords(spark, d):
    return fn.top_words(table(spark, d, "documents"), "doc_id", "text", 8)


QUERIES["keywords"] = keywords
SQL["keywords"] = f"""
with w as (select doc_id, unnest(l) as word, generate_subscripts(l, 1) as nth from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as l from documents)),
c as (select doc_id, word, count(*) as n, min(nth) as nth from w where length(word) > 3 and word not in ({", ".join(f"'{w}'" for w in EXCERPT_STOP)}) group by doc_id, word),
r as (select *, row_number() over (partition by doc_id order by n desc, nth) as place from c)
select doc_id, string_agg(word, ' ' order by place) as keywords from r where place <= 8 group by doc_id"""


def predecessor_trigrams(spark, d):
    """How alike each turn is to the one before it: the runs are computed once for a turn."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", fn.trigrams(F.col("text")).alias("now"))
    met = turns.withColumn("before", F.lag("now").over(op.Window.partitionBy("conv_id").orderBy("turn", "text")))
    return met.select("conv_id", "turn", F.round(F.size(F.array_intersect("now", "before")) / F.size(F.array_union("now", "before")), 4).alias("jaccard")).where("jaccard is not null")


QUERIES["predecessor_trigrams"] = predecessor_trigrams
_GRAMS = "list_distinct(list_transform(generate_series(1, length(p) - 2), lambda i: substring(p, i::int, 3)))"
SQL["predecessor_trigrams"] = f"""
with t as (select conv_id, turn, text, '  ' || trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[\\^`]', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') || ' ' as p from conversations),
g as (select conv_id, turn, {_GRAMS} as a, lag({_GRAMS}) over (partition by conv_id order by turn, text) as b from t)
select conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 4) as jaccard from g where a is not null and b is not null"""
