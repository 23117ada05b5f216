"""Queries over activity: acceptance, sessions, weeks. In the events, a signup starts a job (and a session, which ends at the next error), a purchase is accepted, an error rejected, a view pending and a click superseded."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import activity as op
from ..operators import tallies
from ..sources import table

QUERIES, SQL = {}, {}


def accepted():
    return F.col("event_type") == "purchase"


def rejected():
    return F.col("event_type") == "error"


def kind():
    return F.get_json_object("props", "$.k").cast("int")


def first_accept_by_job(spark, d):
    return op.first_outcome(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "signup", accepted()).select("start_id", "user_id", "seconds")


QUERIES["first_accept_by_job"] = first_accept_by_job
SQL["first_accept_by_job"] = """
with j as (select event_id as start_id, user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as next from events where event_type = 'signup')
select start_id, j.user_id, date_diff('microsecond', any_value(j.ts), min(e.ts)) // 1000000 as seconds
from j left join events e on e.user_id = j.user_id and e.event_type = 'purchase' and e.ts >= j.ts and (j.next is null or e.ts < j.next)
group by start_id, j.user_id"""


def median_first_accept(spark, d):
    jobs = first_accept_by_job(spark, d)
    return jobs.agg(F.count("*").alias("jobs"), F.count("seconds").alias("accepted"), F.expr("percentile(seconds, 0.5)").alias("median_seconds"))


QUERIES["median_first_accept"] = median_first_accept
SQL["median_first_accept"] = f"select count(*) as jobs, count(seconds) as accepted, median(seconds) as median_seconds from ({SQL['first_accept_by_job']})"

QUERIES["accept_rate_by_week"] = lambda spark, d: op.accept_rates(table(spark, d, "events"), [op.week_start("ts").cast("string").alias("week"), (kind() % 5).alias("kind")], accepted(), rejected())
_RATES = "count(*) as produced, count(*) filter (event_type = 'purchase') as accepted, count(*) filter (event_type = 'error') as rejected, round(count(*) filter (event_type = 'purchase') / nullif(count(*) filter (event_type in ('purchase', 'error')), 0)::double, 6) as accept_rate"
_KIND = "cast(json_extract_string(props, '$.k') as int)"
SQL["accept_rate_by_week"] = f"select date_trunc('week', ts)::date::varchar as week, {_KIND} % 5 as kind, {_RATES} from events group by 1, 2"

QUERIES["accept_rate_by_group"] = lambda spark, d: op.accept_rates(
    table(spark, d, "events"), [F.coalesce(F.when(kind() % 7 < 5, F.concat(F.lit("group "), (kind() % 7).cast("string"))), F.lit("ungrouped")).alias("team")], accepted(), rejected()
)
SQL["accept_rate_by_group"] = f"select coalesce(case when {_KIND} % 7 < 5 then 'group ' || ({_KIND} % 7)::varchar end, 'ungrouped') as team, {_RATES} from events group by 1"


def accept_rate_by_locale(spark, d):
    labelled = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rates = op.accept_rates(labelled, [F.col("lang")], F.col("quality") == 1, F.col("quality") == 0)
    return op.rates_for(labelled, rates, "lang", ["de", "en", "es", "fr", "it"]).select("lang", F.coalesce("produced", F.lit(0)).alias("produced"), "accept_rate")


QUERIES["accept_rate_by_locale"] = accept_rate_by_locale
SQL["accept_rate_by_locale"] = """
select l.lang, count(d.doc_id) as produced, round(count(*) filter (quality = 1) / nullif(count(quality), 0)::double, 6) as accept_rate
from (values ('de'), ('en'), ('es'), ('fr'), ('it')) l(lang) left join (select * from documents join labels using (doc_id)) d on d.lang = l.lang group by l.lang"""


def dismissals_by_position(spark, d):
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ranked = table(spark, d, "events").withColumn("position", at)
    return ranked.groupBy("position").agg(F.count("*").alias("produced"), F.round(F.count_if(rejected()) / F.count("*"), 6).alias("dismissal_rate"))


QUERIES["dismissals_by_position"] = dismissals_by_position
SQL["dismissals_by_position"] = """
select position, count(*) as produced, round(count(*) filter (event_type = 'error') / count(*)::double, 6) as dismissal_rate
from (select *, row_number() over (partition by user_id order by ts, event_id) as position from events) group by position"""


def _stamps(spark, d):
    events = table(spark, d, "events").select("ts")
    orders = table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"))
    return events.unionByName(orders).unionByName(table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts")))


def weekly_activity(spark, d):
    anchor = table(spark, d, "events").agg(F.max("ts").alias("anchor"))  # one row
    return op.weekly_histogram(_stamps(spark, d).crossJoin(F.broadcast(anchor)), "ts", F.col("anchor"), 12)


QUERIES["weekly_activity"] = weekly_activity
SQL["weekly_activity"] = """
with s as (select ts from events union all select o_orderdate from orders union all select l_shipdate from lineitem), a as (select max(ts) as anchor from events),
g as (select date_diff('microsecond', ts, anchor) // 1000000 as age, ts, anchor from s, a)
select (age // 604800)::int as weeks_ago, count(*) as n from g where ts <= anchor and age < 12 * 604800 group by 1"""
QUERIES["weekly_activity_dense"] = lambda spark, d: op.dense_buckets(weekly_activity(spark, d), 12)
SQL["weekly_activity_dense"] = f"select (11 - i)::int as bucket, coalesce(n, 0) as n from range(12) r(i) left join ({SQL['weekly_activity']}) w on w.weeks_ago = r.i"


QUERIES["hit_rate_by_segment"] = lambda spark, d: (
    table(spark, d, "customer")
    .join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    .groupBy("c_mktsegment")
    .agg(F.count("o_orderkey").alias("consumed"), F.countDistinct("c_custkey").alias("generated"), F.round(F.try_divide(F.count("o_orderkey"), F.countDistinct("c_custkey")), 6).alias("hit_rate"))
)
SQL["hit_rate_by_segment"] = """
select c_mktsegment, count(o_orderkey) as consumed, count(distinct c_custkey) as generated, round(count(o_orderkey) / nullif(count(distinct c_custkey), 0)::double, 6) as hit_rate
from customer left join orders on c_custkey = o_custkey group by 1"""

QUERIES["pending_plans"] = lambda spark, d: (
    table(spark, d, "orders")
    .groupBy(F.col("o_custkey").alias("plan"))
    .agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("o_orderstatus") == "F").alias("accepted"), F.count_if(F.col("o_orderstatus") == "O").alias("rejected"), F.count("*").alias("total"))
    .where("pending > 0")
)
SQL["pending_plans"] = """
select o_custkey as plan, count(*) filter (o_orderstatus = 'P') as pending, count(*) filter (o_orderstatus = 'F') as accepted, count(*) filter (o_orderstatus = 'O') as rejected, count(*) as total
from orders group by 1 having count(*) filter (o_orderstatus = 'P') > 0"""

QUERIES["nearest_rank_p90"] = lambda spark, d: tallies.quantile(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9)
SQL["nearest_rank_p90"] = """
select l_returnflag, n, l_extendedprice as quantile from (select l_returnflag, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i, count(*) over (partition by l_returnflag) as n from lineitem)
where i = least(floor(0.9::double * n), n - 1)"""
