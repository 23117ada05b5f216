"""Queries that browse, rank, join and walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as op
from ..operators import graph, tallies
from ..sources import table

QUERIES, SQL = {}, {}
#: Region names in a declared order, which is not alphabetical.
ORDER = ["EUROPE", "ASIA", "AFRICA", "AMERICA", "MIDDLE EAST"]


def part_counts(spark, d):
    """Parts with how many lines use them; zero where none does."""
    used = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"), F.countDistinct("l_suppkey").alias("suppliers"))
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return parts.join(used, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", "p_type", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


QUERIES["part_counts"] = part_counts
SQL["part_counts"] = "select p_partkey, p_name, p_type, count(l_partkey) as uses, count(distinct l_suppkey) as suppliers from part left join lineitem on l_partkey = p_partkey group by 1, 2, 3"
QUERIES["part_page"] = lambda spark, d: op.page(part_counts(spark, d), [F.desc("uses"), F.lower("p_name"), F.col("p_partkey")], 2)
SQL["part_page"] = f"select *, (select count(*) from part) as total from ({SQL['part_counts']}) order by uses desc, lower(p_name), p_partkey limit 25 offset 25"
QUERIES["part_last_page"] = lambda spark, d: op.page(part_counts(spark, d), [F.desc("uses"), F.lower("p_name"), F.col("p_partkey")], 1_000_000)
SQL["part_last_page"] = f"""
with p as (select *, row_number() over (order by uses desc, lower(p_name), p_partkey) - 1 as nth, count(*) over () as total from ({SQL['part_counts']}))
select * exclude (nth) from p where nth // 25 = (total - 1) // 25"""
QUERIES["part_page_window"] = lambda spark, d: table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("total")).select("p_brand", "total", *[c.alias(n) for c, n in zip(op.page_window(F.col("total"), 3, 25), ("pages", "page"), strict=True)])
SQL["part_page_window"] = "select p_brand, count(*) as total, greatest(1, ceil(count(*) / 25.0))::int as pages, least(3, greatest(1, ceil(count(*) / 25.0)))::int as page from part group by 1"
QUERIES["region_ordinal"] = lambda spark, d: table(spark, d, "region").select("r_regionkey", "r_name", op.ordinal("r_name", ORDER).alias("ordinal"))
SQL["region_ordinal"] = f"select r_regionkey, r_name, coalesce(nullif(list_position([{', '.join(repr(o) for o in ORDER)}], r_name), 0) - 1, 5)::int as ordinal from region"
QUERIES["ranked_prefix_search"] = lambda spark, d: op.ranked_prefix(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "customer#00000001", 8, "c_custkey")
SQL["ranked_prefix_search"] = """
select * from (select c_custkey, c_name, case when lower(c_name) = 'customer#00000001' then 0 when starts_with(lower(c_name), 'customer#00000001') then 1 when contains(lower(c_name), 'customer#00000001') then 4 end as rank from customer)
where rank is not null order by rank, lower(c_name), c_custkey limit 8"""
QUERIES["latest_order_by_customer"] = lambda spark, d: op.latest_per_key(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")
SQL["latest_order_by_customer"] = "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"
QUERIES["queue_position"] = lambda spark, d: tallies.positions(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority", "o_orderdate"), "o_orderpriority", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")
SQL["queue_position"] = "select o_orderkey, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as position from orders where o_orderstatus = 'O'"
QUERIES["relation_counts"] = lambda spark, d: (
    lambda e: e.select(F.col("l_orderkey").alias("id"), F.lit("order").alias("kind")).unionByName(e.select(F.col("l_partkey").alias("id"), F.lit("part").alias("kind"))).groupBy("kind", "id").agg(F.count("*").alias("relations"))
)(table(spark, d, "lineitem"))
SQL["relation_counts"] = "select kind, id, count(*) as relations from (select 'order' as kind, l_orderkey as id from lineitem union all select 'part', l_partkey from lineitem) group by 1, 2"
QUERIES["never_ordered"] = lambda spark, d: table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
SQL["never_ordered"] = "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)"
QUERIES["active_users"] = lambda spark, d: table(spark, d, "events").select("user_id").union(table(spark, d, "orders").select("o_custkey")).distinct()
SQL["active_users"] = "select user_id from events union select o_custkey from orders"


def nation_trade(spark, d):
    """How many lines touch each nation, as the customer's or the supplier's."""
    by = lambda name, key, nation: table(spark, d, name).select(F.col(key).alias(key), F.col(nation).alias(nation))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(by("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(by("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"))
    return graph.touching(edges)


QUERIES["nation_trade"] = nation_trade
SQL["nation_trade"] = """
with e as (select c_nationkey as source, s_nationkey as target from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)
select n_nationkey as node, count(*) as n from nation join e on source = n_nationkey or target = n_nationkey group by 1"""


def _edges(spark, d):
    lines = table(spark, d, "lineitem").select(F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("relation"), F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("has part").alias("label"), F.lit("is part of").alias("inverse"))
    orders = table(spark, d, "orders").select(F.concat(F.lit("r-"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"), F.lit("placed"), F.lit("placed by"))
    return lines.unionByName(orders.toDF(*lines.columns))


QUERIES["graph_ring"] = lambda spark, d: graph.ring(_edges(spark, d), spark.createDataFrame([("c7",)], "node string"), 3)
SQL["graph_ring"] = """
with recursive e as (select 'l-' || l_orderkey || '-' || l_linenumber as relation, 'o' || l_orderkey as source, 'p' || l_partkey as target, 'has part' as label, 'is part of' as inverse from lineitem
  union all select 'r-' || o_orderkey, 'c' || o_custkey, 'o' || o_orderkey, 'placed', 'placed by' from orders),
b as (select source as node, target as next, relation, label from e union all select target, source, relation, inverse from e),
w(node, depth, relation, via, label) as (select 'c7', 0, null::varchar, null::varchar, null::varchar union select b.next, depth + 1, b.relation, w.node, b.label from w join b on b.node = w.node where depth < 3)
select node, depth::int as depth, relation, via, label from w where node <> 'c7' qualify row_number() over (partition by node order by depth, relation, via) = 1"""


def tree(spark, d):
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("position"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_nationkey")
    customer = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_custkey")
    return graph.flatten(spark, region.union(nation).union(customer))


QUERIES["tree_flatten"] = tree
SQL["tree_flatten"] = """
with recursive t as (select 'r' || r_regionkey as id, null as parent_id, r_regionkey::bigint as position from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, c_custkey from customer),
w(id, depth, path) as (select id, 0, lpad(position::varchar, 6, '0') from t where parent_id is null union all select t.id, depth + 1, path || '/' || lpad(t.position::varchar, 6, '0') from w join t on t.parent_id = w.id)
select id, depth, path from w"""
