"""Queries over logs of writes: confirmations, budgets, decisions, revisions, vocabularies, archives of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, matching, tallies, writes as op
from ..sources import table
from .predicates import _E, edges, events

QUERIES, SQL = {}, {}
QUERIES["first_confirmed"] = lambda spark, d: op.first_kept(events(spark, d), ["user_id", "event_type"], "ts").select("user_id", "event_type", F.col("ts").cast("string").alias("ts"), "writes")
SQL["first_confirmed"] = "select user_id, event_type, rtrim(rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') as ts, count(*) as writes from events group by 1, 2"


def pending_writes(spark, d):
    out = op.coalesced(events(spark, d), ["user_id"], "ts", "event_id", "value", "6 hours")
    return out.select("user_id", "event_id", "value", "writes", F.date_format("run_after", "yyyy-MM-dd HH:mm:ss").alias("run_after"))


QUERIES["pending_writes"] = pending_writes
SQL["pending_writes"] = """
with l as (select *, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as burst from l)
select user_id, min_by(event_id, ts) as event_id, max_by(value, ts) as value, count(*) as writes, strftime(max(ts) + interval 6 hours, '%Y-%m-%d %H:%M:%S') as run_after from s group by user_id, burst"""
QUERIES["repeated_calls"] = lambda spark, d: op.repeats(events(spark, d), "user_id", "event_id", F.col("event_type")).select("event_id", "run", "verdict")
SQL["repeated_calls"] = """
with l as (select *, case when event_type = lag(event_type) over (partition by user_id order by event_id) then 0 else 1 end as fresh from events), r as (select *, sum(fresh) over (partition by user_id order by event_id) as burst from l),
n as (select *, row_number() over (partition by user_id, burst order by event_id) as run from r) select event_id, run, case when run >= 4 then 'end' when run = 3 then 'warn' end as verdict from n"""


def decided(spark, d):
    action = F.get(F.array(F.lit("accept"), F.lit("reject"), F.lit("undo")), F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2))
    log = events(spark, d).withColumn("action", action).where("action is not null")
    return op.transitions(log, "user_id", "event_id", "action").select("event_id", "state", F.col("valid").cast("int").alias("valid"))


QUERIES["decisions"] = decided
SQL["decisions"] = """
with l as (select event_id, user_id, case event_type when 'purchase' then 'accept' when 'error' then 'reject' when 'signup' then 'undo' end as action from events where event_type in ('purchase', 'error', 'signup')),
u as (select *, count(*) filter (action = 'undo') over (partition by user_id order by event_id) as part from l),
f as (select *, first_value(case when action <> 'undo' then action end ignore nulls) over (partition by user_id, part order by event_id rows between unbounded preceding and current row) as first from u)
select event_id, case first when 'accept' then 'accepted' when 'reject' then 'rejected' else 'pending' end as state, (action = 'undo' or action = first)::int as valid from f"""
QUERIES["current_turns"] = lambda spark, d: op.current(table(spark, d, "conversations").withColumn("n", F.struct("turn", "text")), "conv_id", "n").select("conv_id", "turn", "role")
SQL["current_turns"] = "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc, text desc) = 1"


def restored(spark, d):
    turns = table(spark, d, "conversations").withColumn("n", F.struct("turn", "text")).withColumn("revision", F.col("turn"))
    return op.before_accepted(turns, "conv_id", "n", F.col("role") == "assistant").select("conv_id", "restored")


QUERIES["restored_turns"] = restored
SQL["restored_turns"] = """
with l as (select *, lag(turn) over (partition by conv_id order by turn, text) as before from conversations)
select conv_id, before as restored from l where role = 'assistant' qualify row_number() over (partition by conv_id order by turn desc, text desc) = 1"""
QUERIES["persisted_ranks"] = lambda spark, d: table(spark, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("rank"))
SQL["persisted_ranks"] = "select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as rank from events"


def moved_nations(spark, d):
    nations = table(spark, d, "nation").withColumn("position", F.col("n_nationkey").cast("long"))
    moves = spark.createDataFrame([(0, True), (7, False), (24, False)], "n_nationkey int, up boolean")
    return op.swapped(nations, "n_regionkey", "position", moves, "n_nationkey").select("n_nationkey", "position")


QUERIES["moved_nations"] = moved_nations
SQL["moved_nations"] = """
with s as (select n_nationkey as n, lead(n_nationkey) over w as below from nation window w as (partition by n_regionkey order by n_nationkey)), b as (select below from s where n = 7)
select n_nationkey, case when n_nationkey = 7 then coalesce((select below from b), 7) when n_nationkey = (select below from b) then 7 else n_nationkey end::bigint as position from nation"""


def vocabulary(spark, d):
    parts = table(spark, d, "part")
    proposals = parts.select(F.col("p_name").alias("label"), F.col("p_brand").alias("relation"), F.col("p_partkey").alias("nth"))
    pending = spark.createDataFrame([("cold widget", "Cold Widget", ["Brand#1", "Brand#99"]), ("unheard of", "Unheard of", [])], "key string, label string, relations array<string>")
    return op.vocabulary(proposals, pending, F.lower("label"), "relation").select("key", "label", F.array_join("relations", "|").alias("relations"), "times")


QUERIES["vocabulary"] = vocabulary
SQL["vocabulary"] = """
with o as (select lower(p_name) as key, p_name as label, p_brand as r, 1 as late, p_partkey as nth from part union all select 'cold widget', 'Cold Widget', 'Brand#1', 0, 0 union all select 'cold widget', 'Cold Widget', 'Brand#99', 0, 1),
f as (select key, r, min(late * 1000000000 + nth) as nth from o group by key, r), l as (select key, string_agg(r, '|' order by nth) as relations from f group by key)
select key, min_by(label, late * 1000000000 + nth) as label, any_value(relations) as relations, sum(late)::bigint as times from o join l using (key) group by key union all select 'unheard of', 'Unheard of', '', 0"""


def merged_labels(spark, d):
    out, _ = op.merged_edges(edges(spark, d).select("source", "target", F.col("label").alias("type")), "click", "view")
    return out.groupBy("source", "target", "type").agg(F.count("*").alias("n"))


QUERIES["merged_labels"] = merged_labels
SQL["merged_labels"] = f"""
with {_E}, g as (select user_id as source, k::bigint as target, event_type as type from e where user_id <> k), v as (select distinct source, target from g where type = 'view'),
m as (select source, target, case when type = 'click' then 'view' else type end as type from g where type <> 'click' or (source, target) not in (select (source, target) from v)) select source, target, type, count(*) as n from m group by 1, 2, 3"""
QUERIES["merged_counts"] = lambda spark, d: op.merged_edges(edges(spark, d).select("source", "target", F.col("label").alias("type")), "click", "view")[1]
SQL["merged_counts"] = f"""
with {_E}, g as (select user_id as source, k as target, event_type as type from e where user_id <> k), v as (select distinct source, target from g where type = 'view'), c as (select (source, target) in (select (source, target) from v) as held from g where type = 'click')
select count(*) filter (not held) as moved, count(*) filter (held) as deleted from c"""


def freshness(spark, d):
    """Whether what was last made for each user has the fingerprint it should have now."""
    made = events(spark, d).where("event_type <> 'signup'").select(F.col("user_id").alias("key"), (F.col("k") % 3).alias("fingerprint"), F.col("event_id").alias("created"))
    now = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 4).cast("int").alias("fingerprint"))
    return op.freshness(made, now)


QUERIES["freshness"] = freshness
SQL["freshness"] = f"""
with {_E}, m as (select user_id as key, k % 3 as f, event_id from e where event_type <> 'signup'), l as (select key, max_by(f, event_id) as f from m group by key)
select c_custkey as key, case when l.f = c_custkey % 4 then 'fresh' when exists (select 1 from m where m.key = c_custkey and m.f = c_custkey % 4) then 'reused' when l.key is not null then 'stale' else 'missing' end as status from customer left join l on l.key = c_custkey"""


def impact(spark, d):
    owned = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user"))
    return op.deletion_impact(owned, "user", orders=table(spark, d, "orders").withColumnRenamed("o_custkey", "user"), events=table(spark, d, "events").withColumnRenamed("user_id", "user"), vectors=table(spark, d, "embeddings").where("vec_id < 0").withColumnRenamed("vec_id", "user"))


QUERIES["deletion_impact"] = impact
SQL["deletion_impact"] = """
with o as (select c_custkey as u from customer where c_mktsegment = 'MACHINERY')
select 'orders' as name, count(*) as n from orders where o_custkey in (select u from o) union all select 'events', count(*) from events where user_id in (select u from o) union all select 'vectors', 0"""


def universes(spark, d):
    """Customers that ordered, and those that acted, once each; the first set's rows win."""
    first = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("owner").alias("role"))
    second = table(spark, d, "events").select(F.col("user_id").alias("id"), F.lit("member").alias("role"))
    return op.one_of_each(first, second, "id", ["role"])


QUERIES["universes"] = universes
SQL["universes"] = "select id, case when bool_or(o) then 'owner' else 'member' end as role from (select o_custkey as id, true as o from orders union all select user_id, false from events) group by id"
QUERIES["preferred_types"] = lambda spark, d: matching.preferred(
    table(spark, d, "part").select(F.col("p_name").alias("key"), F.when(F.col("p_size") > 40, F.col("p_brand")).alias("owner"), "p_partkey"), "key", "owner", "p_partkey"
)
SQL["preferred_types"] = "select p_name as key, case when p_size > 40 then p_brand end as owner, p_partkey from part qualify row_number() over (partition by p_name order by p_size <= 40, p_partkey) = 1"
QUERIES["ancestors"] = lambda spark, d: graph.ancestors(tree_rows(spark, d)).select("id", "ancestor", "distance")
SQL["ancestors"] = """
with recursive t as (select 'r' || r_regionkey as id, null as parent_id from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
w(id, ancestor, distance) as (select id, parent_id, 1 from t where parent_id is not null union all select w.id, t.parent_id, distance + 1 from w join t on t.id = w.ancestor where t.parent_id is not null) select id, ancestor, distance from w"""


def tree_rows(spark, d):
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    return region.union(nation).union(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))


def buckets(spark, d):
    return tallies.filter_buckets(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "P", ["5-LOW", "absent", "1-URGENT"])


QUERIES["filter_buckets"] = buckets
SQL["filter_buckets"] = """
with t as (select o_orderpriority as type, count(*) as total, count(*) filter (o_orderstatus = 'P') as pending from orders group by 1)
select null as type, count(*) as total, count(*) filter (o_orderstatus = 'P') as pending, 0 as place from orders
union all select type, total, pending, row_number() over (order by case type when '5-LOW' then 1 when '1-URGENT' then 3 else 4 end, type) from t"""
QUERIES["count_distribution"] = lambda spark, d: tallies.distribution(
    table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_mktsegment").agg(F.count("o_orderkey").alias("n_orders")), ["c_mktsegment"], "n_orders", 12, [5, 20]
)
SQL["count_distribution"] = """
with c as (select c_custkey, c_mktsegment, count(o_orderkey) as v from customer left join orders on c_custkey = o_custkey group by 1, 2), r as (select *, row_number() over (partition by c_mktsegment order by v) - 1 as i, count(*) over (partition by c_mktsegment) as m from c)
select c_mktsegment, count(*) as n, round(avg(v), 6) as mean, max(v) as max, round(avg((v = 0)::int), 6) as share_zero, round(avg((v >= 12)::int), 6) as share_at_cap, round(avg((v > 5)::int), 6) as share_over_5, round(avg((v > 20)::int), 6) as share_over_20,
  max(case when i = least(m - 1, floor(0.5::double * m)) then v end) as median, max(case when i = least(m - 1, floor(0.9::double * m)) then v end) as p90 from r group by 1"""
QUERIES["jitter"] = lambda spark, d: tallies.spread(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")
SQL["jitter"] = "select l_suppkey, count(l_quantity) as runs, round(avg(l_quantity), 6) as mean, min(l_quantity) as least, max(l_quantity) as most, round(max(l_quantity) - min(l_quantity), 6) as spread from lineitem group by 1"
QUERIES["weighted_discounts"] = lambda spark, d: table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(tallies.weighted_mean(F.col("l_discount"), F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_quantity"))), 6).alias("mean"))
SQL["weighted_discounts"] = "select l_returnflag, round(coalesce(sum(l_discount * w) / nullif(sum(w), 0), 0), 6) as mean from (select *, case when l_returnflag = 'N' then 0 else l_quantity end as w from lineitem) group by 1"
QUERIES["task_summaries"] = lambda spark, d: table(spark, d, "events").groupBy("event_type").agg(
    F.round(F.avg("value"), 4).alias("mean_score"), F.round(F.avg((F.col("value") < 20).cast("int")), 6).alias("failure_rate"), F.round(F.median("value"), 4).alias("median_latency"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total")
)
SQL["task_summaries"] = "select event_type, round(avg(value), 4) as mean_score, round(avg((value < 20)::int), 6) as failure_rate, round(median(value), 4) as median_latency, round(sum(value::decimal(18, 2))::double, 2) as total from events group by 1"
QUERIES["segment_objects"] = lambda spark, d: table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_nationkey", F.col("c_mktsegment").alias("s")).agg(F.count("c_custkey").alias("n")).groupBy(
    "n_nationkey"
).agg(F.to_json(F.transform_values(tallies.keyed_object(F.col("s"), F.col("n")), lambda _, v: v["n"])).alias("segments"))
SQL["segment_objects"] = """
with c as (select n_nationkey, c_mktsegment as s, count(c_custkey) as n from nation left join customer on n_nationkey = c_nationkey group by 1, 2)
select n_nationkey, '{' || string_agg('"' || s || '":' || n, ',' order by s) || '}' as segments from c group by 1"""


def pulse(spark, d):
    from . import activity

    out = tallies.pulse(activity.weekly_activity(spark, d), 12, F.lit(1), F.lit(None))
    return out.select("state", F.array_join(F.transform("buckets", lambda b: b.cast("string")), ",").alias("buckets"), "total", "latest", "peak")


QUERIES["world_pulse"] = pulse


def _pulse_sql():
    from .activity import SQL as activity

    return f"with w as ({activity['weekly_activity_dense']}) select 'moving' as state, string_agg(n::varchar, ',' order by bucket) as buckets, sum(n)::bigint as total, max(case when bucket = 11 then n end) as latest, max(n) as peak from w"


SQL["world_pulse"] = _pulse_sql()
QUERIES["balances"] = lambda spark, d: table(spark, d, "events").groupBy("user_id").agg(
    F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)"))).alias("p"), F.sum(F.when(F.col("event_type") == "view", F.col("value").cast("decimal(18,2)"))).alias("v")
).select("user_id", (F.coalesce("p", F.lit(0)) + F.coalesce("v", F.lit(0))).cast("double").alias("total"), (F.coalesce("p", F.lit(0)) - F.coalesce("v", F.lit(0))).cast("double").alias("remaining"))
SQL["balances"] = """
with u as (select user_id, coalesce(sum(value::decimal(18, 2)) filter (event_type = 'purchase'), 0) as p, coalesce(sum(value::decimal(18, 2)) filter (event_type = 'view'), 0) as v from events group by 1) select user_id, (p + v)::double as total, (p - v)::double as remaining from u"""


def settled_jobs(spark, d):
    """How each user's events settle: purchases and errors are final, a click only reaches a ceiling."""
    from ..operators import history

    e = events(spark, d).where("user_id % 5 < 4 or event_type not in ('purchase', 'error')")
    return history.settled_or_stopped(e, "user_id", "ts", "event_id", F.col("event_type").isin("purchase", "error"), F.col("event_type") == "click").select("user_id", "event_id", "event_type")


QUERIES["settled_jobs"] = settled_jobs
SQL["settled_jobs"] = """
with e as (select * from events where user_id % 5 < 4 or event_type not in ('purchase', 'error')), f as (select * from e where event_type in ('purchase', 'error') qualify row_number() over (partition by user_id order by ts, event_id) = 1),
c as (select * from e where event_type = 'click' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
select user_id, event_id, event_type from f union all select user_id, event_id, event_type from c where user_id not in (select user_id from f)"""


def revived_refs(spark, d):
    """References to documents after a second import of every third: those are back and refreshed, the others as they were."""
    from ..operators import changes

    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))
    old = docs.select("doc_id", "hash", (F.col("doc_id") % 2 == 0).alias("missing"))
    new = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1_000_000).otherwise(0)).alias("doc_id"), F.reverse("hash").alias("hash"))
    return changes.revived(old, new, ["doc_id"]).select("doc_id", "hash", F.col("missing").cast("int").alias("missing"))


QUERIES["revived_refs"] = revived_refs
SQL["revived_refs"] = """
with d as (select doc_id, md5(text) as h from documents) select doc_id, h as hash, (doc_id % 2 = 0)::int as missing from d where not (doc_id % 3 = 0 and doc_id % 5 > 0) union all select doc_id + case when doc_id % 5 = 0 then 1000000 else 0 end, reverse(h), 0 from d where doc_id % 3 = 0"""


def nested_orders(spark, d):
    """Customers of each nation with their orders, as arrays in arrays."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda o: o["o_orderkey"]).alias("orders"))
    c = table(spark, d, "customer").join(orders, "c_custkey", "left").select("c_nationkey", F.struct("c_custkey", F.coalesce("orders", F.array().cast("array<bigint>")).alias("orders")).alias("c"))
    return c.groupBy("c_nationkey").agg(F.to_json(F.array_sort(F.collect_list("c"))).alias("customers"))


QUERIES["nested_orders"] = nested_orders
SQL["nested_orders"] = """
with o as (select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderdate, o_orderkey) as orders from orders group by 1)
select c_nationkey, '[' || string_agg('{"c_custkey":' || c_custkey || ',"orders":[' || coalesce(orders, '') || ']}', ',' order by c_custkey) || ']' as customers from customer left join o on o_custkey = c_custkey group by 1"""


def accepted(spark, d):
    """Customers after the proposals that their orders stand for: updates, creates whose slug may be taken, and flags."""
    known = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity"), F.concat(F.lit("c-"), "c_custkey").alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("body"))
    kind = F.get(F.array(F.lit("update"), F.lit("create"), F.lit("flag")), (F.col("o_orderkey") % 3).cast("int"))
    name = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("N"), "o_orderkey"))
    found = table(spark, d, "orders").select(F.col("o_orderkey").alias("proposal"), kind.alias("kind"), F.col("o_custkey").cast("string").alias("entity"), F.concat(F.lit("c-"), (F.col("o_custkey") * 2).cast("string")).alias("slug"), name.alias("name"), F.col("o_orderpriority").alias("body"), F.col("o_orderkey").alias("decided"))
    return op.accepted_revisions(known, found).select("entity", "slug", "name", "body", F.col("revisions").cast("long").alias("revisions"))


QUERIES["accepted_proposals"] = accepted
SQL["accepted_proposals"] = """
with e as (select c_custkey::varchar as entity, 'c-' || c_custkey as slug, c_name as name, c_mktsegment as body from customer),
a as (select o_orderkey as p, o_orderkey % 3 as kind, o_custkey::varchar as entity, 'c-' || o_custkey * 2 as slug, case when o_orderkey % 2 = 1 then 'N' || o_orderkey end as name, o_orderpriority as body from orders),
n as (select coalesce(e.entity, 'new-' || min(p) over (partition by a.slug)) as entity, a.slug, a.name, a.body, p from a left join e on e.slug = a.slug where kind = 1),
log as (select entity, slug, name, body, -1 as p, 0 as w from e union all select entity, slug, name, body, p, 1 from a where kind = 0 and entity in (select entity from e) union all select *, 1 from n)
select entity, arg_min(slug, p) as slug, arg_max(name, p) filter (name is not null) as name, arg_max(body, p) filter (body is not null) as body, sum(w)::bigint as revisions from log group by entity"""


def publishing(spark, d):
    """What keeps suppliers' plans from being published: nations are their sessions, some of which are places; every tenth plan is there twice."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("n-"), "s_nationkey").alias("session"), F.concat(F.lit("c-"), (F.col("s_suppkey") * 20).cast("string")).alias("slug"), "s_suppkey")
    plan = s.unionByName(s.where("s_suppkey % 10 = 0")).drop("s_suppkey")
    seen = lambda key: F.when(F.col(key) % 4 == 0, "gm_only").otherwise("players").alias("visibility")
    entities = table(spark, d, "customer").select(F.concat(F.lit("c-"), "c_custkey").alias("slug"), F.lit("character").alias("type"), F.when(F.col("c_custkey") % 40 == 0, "gm_only").otherwise("players").alias("visibility"))
    sessions = table(spark, d, "nation").select(F.concat(F.lit("n-"), "n_nationkey").alias("slug"), F.when(F.col("n_nationkey") % 3 == 0, "place").otherwise("session").alias("type"), seen("n_nationkey"))
    return op.publish_problems(plan, entities.unionByName(sessions))


QUERIES["publish_problems"] = publishing
SQL["publish_problems"] = """
with s as (select 'n-' || s_nationkey as session, 'c-' || s_suppkey * 20 as slug, s_suppkey from supplier), p as (select session, slug from s union all select session, slug from s where s_suppkey % 10 = 0),
e as (select 'c-' || c_custkey as slug, 'character' as type, c_custkey % 40 = 0 as hidden from customer union all select 'n-' || n_nationkey, case when n_nationkey % 3 = 0 then 'place' else 'session' end, n_nationkey % 4 = 0 from nation),
r as (select slug, false as is_session from p union select session, true from p)
select r.slug, case when e.slug is null then 'missing' when hidden then 'hidden' else 'not a session' end as problem from r left join e on e.slug = r.slug where e.slug is null or hidden or (is_session and type <> 'session')
union all select slug, 'duplicated' from p group by slug having count(*) > 1"""
