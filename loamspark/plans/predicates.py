"""Queries over predicates and decisions. An event's number k stands for what its row lacks: owners, reasons, styles, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as fn
from ..operators import retrieval
from ..sources import table

QUERIES, SQL = {}, {}
_K = "cast(json_extract_string(props, '$.k') as int)"


def k():
    return F.get_json_object("props", "$.k").cast("int")


def events(spark, d):
    return table(spark, d, "events").withColumn("k", k())


_E = f"e as (select *, {_K} as k from events)"


def optional_filters(spark, d):
    """Orders by the conditions that are given; one is not."""
    given = [F.col("o_orderstatus") == "F", None, fn.within_days(F.col("o_orderdate"), F.lit("1998-06-01").cast("timestamp_ntz"), 90), fn.within_days(F.col("o_orderdate"), F.lit("1998-06-01").cast("timestamp_ntz"), 0)]
    return table(spark, d, "orders").where(fn.all_of(given)).select("o_orderkey", "o_custkey")


QUERIES["optional_filters"] = optional_filters
SQL["optional_filters"] = "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1998-06-01' - interval 90 days"


def alias_search(spark, d):
    """Parts whose name, brand or type (their aliases) or both as a text match; the underscore is a wildcard."""
    rows = table(spark, d, "part").withColumn("aliases", F.array("p_brand", "p_type"))
    return rows.where(fn.matches_any("d#1_", F.col("p_name"), F.col("aliases"), F.concat_ws(" ", "p_type", "p_name"))).select("p_partkey")


QUERIES["alias_search"] = alias_search
SQL["alias_search"] = "select p_partkey from part where p_name ilike '%d#1_%' or len(list_filter([p_brand, p_type], lambda a: a ilike '%d#1_%')) > 0 or p_type || ' ' || p_name ilike '%d#1_%'"


def graded(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")


QUERIES["unlabelled"] = lambda spark, d: graded(spark, d).where(fn.equals_or_null(F.col("quality"), None)).select("doc_id")
SQL["unlabelled"] = "select doc_id from documents left join labels using (doc_id) where quality is not distinct from null"
QUERIES["global_or_owned"] = lambda spark, d: graded(spark, d).where(fn.global_or_owned(F.col("quality"), 1)).select("doc_id", "quality")
SQL["global_or_owned"] = "select doc_id, quality from documents left join labels using (doc_id) where quality is null or quality = 1"
QUERIES["visible_documents"] = lambda spark, d: graded(spark, d).where(fn.visible(F.when(F.col("toxic") == 1, "gm_only").otherwise("players"))).select("doc_id")
SQL["visible_documents"] = "select doc_id from documents left join labels using (doc_id) where case when toxic = 1 then 'gm_only' else 'players' end <> 'gm_only'"
QUERIES["undrafted"] = lambda spark, d: events(spark, d).where(fn.empty_object(F.when(F.col("k") % 7 == 0, " { } ").otherwise(F.col("props")))).select("event_id")
SQL["undrafted"] = f"with {_E} select event_id from e where len(json_keys(case when k % 7 = 0 then ' {{ }} ' else props end)) = 0"
PATTERNS = ["http://*.example.org/*", "*utm_source=feed", "https://m.*/en/9?", "https://blog.therst.example.net/en/53?utm_source=feed", "*.NET/de/1*"]


def kept_pages(spark, d):
    """Pages that no pattern excludes."""
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return retrieval.not_excluded(table(spark, d, "pages").select("page_id", "url"), "url", patterns).select("page_id")


QUERIES["kept_pages"] = kept_pages
_GLOB = r"regexp_replace(lower(p), '[.+?^${}()|\[\]\\]', '\\\0', 'g')"
SQL["kept_pages"] = f"""
with p as (select unnest({PATTERNS!r}) as p)
select page_id from pages where not exists (select 1 from p where regexp_full_match(lower(url), replace({_GLOB}, '*', '.*'), 's'))"""


def edges(spark, d):
    """Users and numbers as nodes of one kind: an edge for each event, its type as label."""
    return events(spark, d).where("user_id <> k").select("event_id", F.col("user_id").alias("source"), F.col("k").cast("long").alias("target"), F.col("event_type").alias("label"))


def relations_seen(spark, d):
    """Relations of each customer that has an end of them: the other end, and the label as read from this one."""
    e = edges(spark, d)
    both = e.withColumn("node", F.explode(F.array("source", "target")))
    near = both.select("event_id", "node", fn.other_end(F.col("source"), F.col("target"), F.col("node")).alias("other"), fn.label_from(F.col("source"), F.col("node"), F.col("label"), F.concat(F.lit("inverse "), "label")).alias("label"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("other"), F.col("c_name").alias("other_name"))
    return near.join(customers, "other").select("event_id", "node", "other_name", "label")


QUERIES["relations_seen"] = relations_seen
SQL["relations_seen"] = f"""
with {_E}, g as (select event_id, user_id as source, k as target, event_type as label from e where user_id <> k), n as (select *, unnest([source, target]) as node from g)
select event_id, node, c_name as other_name, case when source = node then label else 'inverse ' || label end as label from n join customer on c_custkey = case when source = node then target else source end"""


def shown_labels(spark, d):
    """Regions' names for their nations, where there is no better (left join with a condition on the right side)."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    met = nation.join(region, (F.col("n_regionkey") == F.col("r_regionkey")) & F.col("r_name").startswith("A"), "left")
    return met.select("n_nationkey", F.coalesce("r_name", "n_name").alias("label"))


QUERIES["shown_labels"] = shown_labels
SQL["shown_labels"] = "select n_nationkey, coalesce(r_name, n_name) as label from nation left join region on n_regionkey = r_regionkey and r_name like 'A%'"


def fresh_lines(spark, d):
    """Whether a line was shipped after its order was written."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count_if(F.col("l_shipdate") > F.col("o_orderdate")).alias("fresh"), F.count("*").alias("lines"))


QUERIES["fresh_lines"] = fresh_lines
SQL["fresh_lines"] = "select o_orderkey, count(*) filter (l_shipdate > o_orderdate) as fresh, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey group by o_orderkey"


def styles(spark, d):
    override = F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 5 == 1, "ink")
    universe = F.when(F.col("k") % 3 == 0, "oil")
    modifier, source = fn.style(override, universe)
    return events(spark, d).select("event_id", modifier.alias("modifier"), source.alias("source"))


QUERIES["styles"] = styles
SQL["styles"] = f"""
with {_E}, s as (select event_id, case when k % 5 = 0 then '' when k % 5 = 1 then 'ink' end as o, case when k % 3 = 0 then 'oil' end as u from e)
select event_id, coalesce(o, u) as modifier, case when o is not null then 'entry' when u is not null then 'universe' else 'none' end as source from s"""
RAW = ["wrong", " Already True ", "too much", "TOO_MUCH", "prose", "not canon yet", "dull", ""]


def raw_reason():
    return F.get(F.array(*map(F.lit, RAW)), F.col("k") % 9)


_RAW = f"({RAW!r})[k % 9 + 1]"
_REASON = f"""coalesce(case lower(trim({_RAW})) when 'wrong' then 'wrong' when 'already true' then 'already_true' when 'already_true' then 'already_true' when 'not canon yet' then 'not_canon_yet'
  when 'too much' then 'too_much' when 'too_much' then 'too_much' when 'prose' then 'prose' end, 'other')"""
QUERIES["reasons"] = lambda spark, d: events(spark, d).groupBy(fn.reason(raw_reason()).alias("reason")).agg(F.count("*").alias("n"))
SQL["reasons"] = f"with {_E} select {_REASON} as reason, count(*) as n from e group by 1"


def caps(spark, d):
    """What is left of each user's cap of 6 after its twenty latest reasons; one user in four has no cap."""
    at = F.row_number().over(retrieval.Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = events(spark, d).withColumn("at", at).where("at <= 20").groupBy("user_id").agg(F.collect_list(raw_reason()).alias("recent"))
    return recent.select("user_id", fn.effective_cap(F.when(F.col("user_id") % 4 > 0, 6), F.col("recent")).alias("cap"))


QUERIES["effective_caps"] = caps
SQL["effective_caps"] = f"""
with {_E}, r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as nth from e)
select user_id, case when user_id % 4 > 0 then greatest(3, 6 - count(*) filter ({_REASON} = 'too_much'))::int end as cap from r where nth <= 20 group by user_id"""


def quotas(spark, d):
    by = events(spark, d).groupBy("user_id").agg(F.count("*").alias("jobs"), F.sum("k").alias("documents"), F.round(F.sum("value")).cast("long").alias("credits"))
    why = fn.quota(F.when(F.col("user_id") % 3 > 0, 60), F.col("jobs"), F.when(F.col("user_id") % 5 > 0, 3000), F.col("documents"), F.lit(40), F.col("credits"), F.lit(4000))
    return by.select("user_id", why.alias("refused"))


QUERIES["import_quotas"] = quotas
SQL["import_quotas"] = f"""
with {_E}, u as (select user_id, count(*) as jobs, sum(k) as documents, round(sum(value))::bigint as credits from e group by user_id)
select user_id, case when user_id % 3 > 0 and jobs + 1 > 60 then 'jobs_quota' when user_id % 5 > 0 and documents + 40 > 3000 then 'documents_quota' when credits < 4000 then 'insufficient_credits' end as refused from u"""


def budgets(spark, d):
    tier = F.get(F.array(F.lit("text"), F.lit("draft"), F.lit("media")), F.col("k") % 3)
    allowed = fn.may_spend(tier, F.lit(100.0), F.lit(100.0) - F.col("k"), F.lit(20.0))
    return events(spark, d).select("event_id", allowed.cast("int").alias("allowed"), fn.radius(F.when(F.col("k") > 9, F.col("k") / 100)).alias("radius"))


QUERIES["warm_budgets"] = budgets
SQL["warm_budgets"] = f"""
with {_E} select event_id, (100 - k - 20 >= 100 * (case k % 3 when 0 then 0 when 1 then 0.1 else 0.3 end))::int as allowed, case when k > 9 and k / 100.0 < 0.3 then 1 else 2 end as radius from e"""


def params(spark, d):
    new = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"k":"new","v":"'), F.col("event_type"), F.lit('"}'))).otherwise('{"other":"x"}')
    old = F.concat(F.lit('{"a":"'), F.col("user_id").cast("string"), F.lit('","k":"'), F.col("k").cast("string"), F.lit('"}'))
    return events(spark, d).select("event_id", fn.merged_params(old, new, ["k", "v"]).alias("params"))


QUERIES["merged_params"] = params
SQL["merged_params"] = f"""with {_E} select event_id, case when k % 2 = 0 then '{{"a":"' || user_id || '","k":"new","v":"' || event_type || '"}}' else '{{"a":"' || user_id || '"}}' end as params from e"""


def caveats(spark, d):
    kinds = F.filter(F.array(F.when(F.col("k") % 2 == 0, "embedding"), F.when(F.col("k") % 5 == 0, "instruction"), F.when(F.col("k") % 7 == 0, "mention"), F.when(F.col("k") % 11 == 0, "rumour")), lambda x: x.isNotNull())
    rows = events(spark, d).withColumn("evidence", F.to_json(F.transform(kinds, lambda x: F.struct(x.alias("kind")))))
    return rows.select("event_id", fn.evidence_caveat(F.when(F.col("k") % 13 == 0, "import").otherwise("edit"), F.when(F.col("k") % 17 == 0, "{").otherwise(F.col("evidence"))).alias("caveat"))


QUERIES["evidence_caveats"] = caveats
SQL["evidence_caveats"] = f"""
with {_E} select event_id, case when k % 13 = 0 or k % 17 = 0 or k % 7 = 0 then null when k % 5 = 0 then 'instructionOnly' when k % 2 = 0 then 'embeddingOnly' end as caveat from e"""



def evidence_rows(spark, d):
    """A row for each view of an event's evidence, or one where it has none. Every thirteenth event stands for an import, the others for edits."""
    k, word = F.col("k"), F.col("event_type")
    entries = [
        F.when(k % 2 == 0, F.concat(F.lit('{"kind":"embedding","similarity":0.5,"sourceSentence":"Like '), word, F.lit('."}'))),
        F.when(k % 5 == 0, F.concat(F.lit('{"kind":"instruction","instruction":"Do '), k, F.lit('"}'))),
        F.when(k % 7 == 0, F.concat(F.lit('{"kind":"mention","direction":"'), F.when(k % 4 == 0, "reverse").otherwise("forward"), F.lit('","matchedText":"'), word, F.lit('","sourceSentence":"Saw '), word, F.lit('."}'))),
        F.when(k % 3 == 0, F.concat(F.lit('{"kind":"relation","hops":'), k % 4, F.lit(',"path":["'), word, F.lit('","u'), F.col("user_id"), F.lit('"]}'))),
        F.when(k % 11 == 0, F.lit('{"kind":"rumour","path":["x"]}')),
        F.when(k % 19 == 0, F.lit("7")),
    ]
    edited = F.concat(F.lit("["), F.concat_ws(",", *entries), F.lit("]"))
    path = F.when(k % 2 == 0, F.concat(F.lit('"a/'), k, F.lit('.md"'))).otherwise(k.cast("string"))
    similar = F.when(k % 3 == 0, F.concat(F.lit(',"similarity":0.'), k % 9)).when(k % 3 == 1, ',"similarity":"0.5"').otherwise("")
    others = F.concat(F.lit(',"ambiguousCandidateIds":['), F.when(k % 4 > 0, F.array_join(F.sequence(F.lit(1), k % 4), ",")).otherwise(""), F.lit("]"))
    imported = F.concat(F.lit('{"sourceRef":{"path":'), path, F.lit("}"), similar, others, F.lit("}"))
    is_import = k % 13 == 0
    seen = events(spark, d).select("event_id", fn.evidence_views(F.when(is_import, "import").otherwise("edit"), F.when(k % 17 == 0, "{").when(is_import, imported).otherwise(edited)).alias("e"))
    rows = seen.select("event_id", F.col("e.caveat").alias("caveat"), F.posexplode_outer("e.views").alias("nth", "v"))
    return rows.select("event_id", "caveat", "nth", "v.quote", "v.kind", F.array_join("v.path", "/").alias("path"), "v.hops", "v.direction", "v.matched", "v.source", F.col("v.count").alias("others"))


QUERIES["evidence_views"] = evidence_rows
SQL["evidence_views"] = f"""
with {_E}, v as (
  select event_id, 1 as o, 'Like ' || event_type || '.' as quote, 'embedding' as kind, null as path, null as hops, null as direction, null as matched, null as source, null as others from e where k % 2 = 0 and k % 13 > 0
  union all select event_id, 2, 'Do ' || k, 'instruction', null, null, null, null, null, null from e where k % 5 = 0 and k % 13 > 0
  union all select event_id, 3, 'Saw ' || event_type || '.', 'mention', null, null, case when k % 4 = 0 then 'reverse' else 'forward' end, event_type, null, null from e where k % 7 = 0 and k % 13 > 0
  union all select event_id, 4, null, 'relation', event_type || '/u' || user_id, k % 4, null, null, null, null from e where k % 3 = 0 and k % 13 > 0
  union all select event_id, 5, null, case when k % 3 > 0 then 'importExtracted' when k % 4 > 0 then 'importAmbiguous' else 'importMatched' end, null, null, null, null, case when k % 2 = 0 then 'a/' || k || '.md' end, case when k % 3 = 0 and k % 4 > 0 then k % 4 end from e where k % 13 = 0)
select e.event_id, case when k % 13 = 0 then case when k % 3 = 0 and k % 17 > 0 then 'embeddingOnly' end when k % 17 = 0 or k % 7 = 0 or k % 3 = 0 then null when k % 5 = 0 then 'instructionOnly' when k % 2 = 0 then 'embeddingOnly' end as caveat,
  case when v.event_id is not null then row_number() over (partition by e.event_id order by o) - 1 end::int as nth, quote, kind, path, hops::int as hops, direction, matched, source, others::int as others
from e left join v on v.event_id = e.event_id and k % 17 > 0"""


def estimates(spark, d):
    by = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    e = fn.job_estimate(F.col("n"), F.col("k") / 10, F.col("k") / 100)
    return by.select("user_id", e["minutes"].alias("minutes"), e["credits"].alias("credits"), e["budget"].alias("budget"), e["timeout_ms"].alias("timeout_ms"))


QUERIES["job_estimates"] = estimates
SQL["job_estimates"] = f"""
with {_E}, u as (select user_id, count(*) as n, max(k) as k from e group by user_id), m as (select user_id, greatest(1, ceil(n * (k / 10.0::double) / 60))::bigint as minutes, ceil(n * (k / 100.0::double))::bigint as credits from u)
select *, credits * 6 as budget, greatest(300000, minutes * 180000) as timeout_ms from m"""
DETAILS = [*fn.RUN_REASONS, "model call failed: Boom", "stuck in a loop: read was called with identical arguments 4 times in a row, so this document was ended rather than run to its step ceiling", "odd"]


def run_reasons(spark, d):
    detail = F.get(F.array(*map(F.lit, DETAILS)), F.col("k") % len(DETAILS))
    r = fn.run_reason(detail)
    return events(spark, d).select("event_id", r["reason"].alias("reason"), r["about"].alias("about"))


QUERIES["run_reasons"] = run_reasons
_CODES = [*fn.RUN_REASONS.values(), "model_call_failed", "loop_guard", "other"]
_ABOUT = f"[{', '.join(['null'] * len(fn.RUN_REASONS))}, 'Boom', 'read', 'odd']"
SQL["run_reasons"] = f"with {_E} select event_id, ({_CODES!r})[k % {len(DETAILS)} + 1] as reason, ({_ABOUT})[k % {len(DETAILS)} + 1] as about from e"
