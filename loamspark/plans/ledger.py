"""Queries over ledgers, costs and keyed writes. Two exports of the documents are its halves by doc_id, overlapping in every third row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, ledger
from ..sources import table
from ..streaming import debounce

QUERIES, SQL = {}, {}
_SIGNED = "case when event_type = 'purchase' then -abs(value) else abs(value) end"


def signed():
    return F.when(F.col("event_type") == "purchase", -F.abs("value")).otherwise(F.abs("value"))


def balances(spark, d):
    rows = ledger.idempotent(table(spark, d, "events"), ["user_id", "props"], ["event_id"])
    out = ledger.running_balance(rows, "user_id", signed(), ["ts", "event_id"])
    return out.select("event_id", "user_id", F.round("balance", 3).alias("balance"))


QUERIES["ledger_balance"] = balances
SQL["ledger_balance"] = f"""
with i as (select * from events qualify user_id is null or props is null or row_number() over (partition by user_id, props order by event_id) = 1)
select event_id, user_id, round(sum({_SIGNED}) over (partition by user_id order by ts, event_id rows unbounded preceding), 3) as balance from i"""
QUERIES["two_pool_split"] = lambda spark, d: table(spark, d, "customer").select("c_custkey", *[F.round(c, 4).alias(n) for c, n in zip(ledger.two_pools(F.col("c_acctbal"), F.lit(2500.0)), ("first_pool", "second_pool"), strict=True)])
SQL["two_pool_split"] = "select c_custkey, round(least(greatest(c_acctbal, 0), 2500.0::double), 4) as first_pool, round(2500 - least(greatest(c_acctbal, 0), 2500.0::double), 4) as second_pool from customer"
QUERIES["token_cost"] = lambda spark, d: (
    table(spark, d, "lineitem")
    .groupBy("l_suppkey")
    .agg(F.round(F.sum(ledger.token_cost(F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount"), F.col("l_quantity"), (3.0, 0.3, 15.0))), 6).alias("cost"))
)
SQL["token_cost"] = "select l_suppkey, round(sum((l_extendedprice - l_extendedprice * l_discount) * 3.0::double + l_extendedprice * l_discount * 0.3::double + l_quantity * 15.0::double) / 1000000, 6) as cost from lineitem group by 1"


def price_as_of(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts"))
    log = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.max("l_extendedprice").alias("price"))
    return ledger.as_of(lines, log, "part", "ts", "price").select("l_orderkey", "l_linenumber", "part", "price")


QUERIES["price_as_of"] = price_as_of
SQL["price_as_of"] = """
with l as (select l_orderkey, l_linenumber, l_partkey as part, l_shipdate as ts from lineitem),
c as (select l_partkey as part, date_trunc('month', l_shipdate)::timestamp as ts, max(l_extendedprice) as price from lineitem group by 1, 2)
select l_orderkey, l_linenumber, l.part, price from l asof left join c on l.part = c.part and l.ts >= c.ts"""
QUERIES["usage_windows"] = lambda spark, d: table(spark, d, "events").groupBy("user_id", F.window("ts", "30 days").start.cast("string").alias("since")).agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("used"), F.count("*").alias("calls"))
SQL["usage_windows"] = "select user_id, strftime(time_bucket(interval '30 days', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as since, round(coalesce(sum(value), 0), 4) as used, count(*) as calls from events group by 1, 2"


def _exports(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    new = docs.where("doc_id % 2 = 1 or doc_id % 3 = 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return docs.where("doc_id % 2 = 0 or doc_id % 3 = 0"), new


_EXPORTS = """with o as (select doc_id, text, source from documents where doc_id % 2 = 0 or doc_id % 3 = 0),
n as (select doc_id, case when doc_id % 5 = 0 then text || '!' else text end as text, source from documents where doc_id % 2 = 1 or doc_id % 3 = 0)"""
QUERIES["export_upsert"] = lambda spark, d: changes.upsert(*_exports(spark, d), "doc_id").select("doc_id", F.md5("text").alias("digest"))
SQL["export_upsert"] = f"{_EXPORTS} select coalesce(n.doc_id, o.doc_id) as doc_id, md5(case when n.doc_id is not null then n.text else o.text end) as digest from o full join n on o.doc_id = n.doc_id"
QUERIES["export_insert_absent"] = lambda spark, d: changes.insert_absent(*_exports(spark, d), "doc_id").select("doc_id", F.md5("text").alias("digest"))
SQL["export_insert_absent"] = f"{_EXPORTS} select coalesce(o.doc_id, n.doc_id) as doc_id, md5(case when o.doc_id is not null then o.text else n.text end) as digest from o full join n on o.doc_id = n.doc_id"
QUERIES["export_missing"] = lambda spark, d: changes.mark_missing(*_exports(spark, d), "doc_id").select("doc_id", "missing")
SQL["export_missing"] = f"{_EXPORTS} select o.doc_id, n.doc_id is null as missing from o left join n on o.doc_id = n.doc_id"
QUERIES["export_changed"] = lambda spark, d: changes.changed_by_hash(*_exports(spark, d), "doc_id", "text")
SQL["export_changed"] = f"{_EXPORTS} select n.doc_id, case when o.doc_id is null then 'new' when sha256(o.text) = sha256(n.text) then 'same' else 'changed' end as status from n left join o on o.doc_id = n.doc_id"


def debounced(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("body", F.col("event_id").cast("string"))
    out = debounce.debounced(debounce.once(rows, "event_id", "ts"), "user_id", "ts", "body", "12 hours")
    return out.select("user_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.date_format("fires_at", "yyyy-MM-dd HH:mm:ss").alias("fires_at"), "n")


QUERIES["debounced_writes"] = debounced
SQL["debounced_writes"] = """
with g as (select user_id, ts, case when ts - lag(ts) over w < interval '12 hours' then 0 else 1 end as fresh from events where user_id is not null window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as burst from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started_at, strftime(max(ts) + interval '12 hours', '%Y-%m-%d %H:%M:%S') as fires_at, count(*) as n from s group by user_id, burst"""
