"""Queries over sources and sinks: lookups, vector collections, increments, and connectors fed with texts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import browse
from ..sources import archives, connectors, small_batches, spread, table, vectors
from .predicates import _E, events

QUERIES, SQL = {}, {}


def point(spark, d):
    """One customer by key, and several by a list; an empty list gives nothing."""
    c = table(spark, d, "customer")
    rows = browse.by_key(c, "c_custkey", 7).unionByName(browse.by_keys(c, "c_custkey", [3, 5, 10**9])).unionByName(browse.by_keys(c, "c_custkey", []))
    return rows.select("c_custkey", "c_name")


QUERIES["key_lookups"] = point
SQL["key_lookups"] = "select c_custkey, c_name from customer where c_custkey in (3, 5, 7)"


def collection(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


QUERIES["vector_scroll"] = lambda spark, d: vectors.scrolled(vectors.ready(collection(spark, d), collection(spark, d).limit(0), 64), {"label": 1}, 5).select("id", "label")
SQL["vector_scroll"] = "select vec_id as id, label from embeddings where label = 1 order by vec_id limit 5"
QUERIES["vector_count"] = lambda spark, d: vectors.counted(collection(spark, d).withColumn("even", F.col("id") % 2 == 0), {"even": True}, {"label": 1})
SQL["vector_count"] = "select count(*) as n from embeddings where vec_id % 2 = 0 and label <> 1"


def upserted(spark, d):
    old = collection(spark, d).select("id", "label")
    new = old.where("id % 3 = 0").select((F.col("id") + 10_000 * (F.col("id") % 2)).alias("id"), F.lit(99).cast(old.schema["label"].dataType).alias("label"))
    kept = vectors.deleted(vectors.upserted(old, new), old.where("id % 5 = 0").select("label", "id"))
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


QUERIES["vector_upserts"] = upserted
SQL["vector_upserts"] = """
with n as (select vec_id + 10000 * (vec_id % 2) as id, 99 as label from embeddings where vec_id % 3 = 0), u as (select vec_id as id, label from embeddings where vec_id not in (select id from n) union all select * from n)
select label, count(*) as n, sum(id)::bigint as ids from u where (label, id) not in (select (label, vec_id) from embeddings where vec_id % 5 = 0) group by label"""


def reindexed(spark, d):
    """Pages whose stamp changed get new chunks; others keep theirs, also beside others of their address. Running it again changes nothing."""
    page = ["page_id", "url"]
    pages = table(spark, d, "pages").select(*page, F.length("html").alias("page_updated_at"))
    old = pages.withColumn("page_updated_at", F.col("page_updated_at") - F.when(F.col("page_updated_at") % 3 == 0, 1).otherwise(0)).select(*page, "page_updated_at", F.lit("old").alias("chunk"))
    chunks = pages.select(*page, "page_updated_at", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("chunk"))
    once = vectors.reindexed(old, pages, chunks, tuple(page))
    return vectors.reindexed(once, pages, chunks, tuple(page)).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("page_updated_at").cast("long").alias("stamps"))


QUERIES["reindexed_pages"] = reindexed
SQL["reindexed_pages"] = """
with c as (select unnest(case when length(html) % 3 = 0 then ['a', 'b'] else ['old'] end) as chunk, length(html) as l from pages) select chunk, count(*) as n, sum(l)::bigint as stamps from c group by chunk"""
QUERIES["unfinished_documents"] = lambda spark, d: vectors.unfinished(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
SQL["unfinished_documents"] = "select doc_id from documents where doc_id not in (select doc_id from labels)"


def late_periods(spark, d):
    """Grants of users in the order they come: a replayed id is ignored, an older period counts nothing."""
    from ..operators import history

    rows = events(spark, d)
    return history.stale(rows, "user_id", "event_id", "k").select("event_id", F.when(F.col("stale"), 0).otherwise(F.col("k")).alias("granted"))


QUERIES["late_periods"] = late_periods
SQL["late_periods"] = f"with {_E}, m as (select *, max(k) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from e) select event_id, case when k <= before then 0 else k end as granted from m"


def paths(spark, d):
    name = F.get(F.array(F.lit("a\\b\\./c.txt"), F.lit("/abs"), F.lit("C:\\x"), F.lit("x/../y"), F.lit("./"), F.lit("d//e.md"), F.lit("")), F.col("k") % 7)
    return events(spark, d).select("event_id", archives.entry_path(name).alias("path"))


QUERIES["entry_paths"] = paths
SQL["entry_paths"] = f"with {_E} select event_id, case k % 7 when 0 then 'a/b/c.txt' when 5 then 'd/e.md' end as path from e"


def listed(spark, d):
    """Pages as entries of folders by language and parity."""
    entries = table(spark, d, "pages").select(F.concat(F.regexp_extract("url", "/(..)/", 1), F.lit("/"), F.col("page_id") % 2, F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("/p"), "page_id")), F.lit(".html")).alias("path"), F.length("html").alias("size"))
    return archives.listing(entries, "en")


QUERIES["folder_listing"] = listed
SQL["folder_listing"] = r"""
with e as (select regexp_extract(url, '/(..)/', 1) || '/' || page_id % 2 || case when page_id % 3 = 0 then '' else '/p' || page_id end || '.html' as path, length(html) as size from pages), i as (select *, substring(path, 4) as rest from e where starts_with(path, 'en/'))
select 'en/' || string_split(rest, '/')[1] as path, case when bool_or(contains(rest, '/')) then 'directory' else 'file' end as kind, max(case when not contains(rest, '/') then size end) as size from i group by 1"""


def text_sniff(spark, d):
    bytes_ = F.when(F.col("doc_id") % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(F.col("doc_id") % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).otherwise(F.encode("text", "UTF-8"))
    small_batches(spark)
    rows = table(spark, d, "documents").select("doc_id", archives.decoded(bytes_).alias("x"))
    return rows.select("doc_id", F.md5("x.text").alias("digest"), F.col("x.truncated").cast("int").alias("truncated"), archives.reads_as_text(F.concat(F.when(F.col("doc_id") % 5 == 0, "\0").otherwise(""), "x.text")).cast("int").alias("is_text"))


QUERIES["decoded_texts"] = text_sniff
SQL["decoded_texts"] = "select doc_id, md5(text) as digest, 0 as truncated, (trim(case when doc_id % 5 = 0 then 'x' else text end, ' ') <> '' and doc_id % 5 <> 0)::int as is_text from documents"


def export_records(spark, d):
    """Nations' customers as files of records with relations to each other."""
    c = table(spark, d, "customer").withColumn("kind", F.get(F.array(F.lit("character"), F.lit("family"), F.lit("map")), (F.col("c_custkey") % 3).cast("int")))
    record = F.struct(
        F.col("c_custkey").alias("entity_id"), F.col("kind").alias("entity_type"), F.col("c_name").alias("name"), F.concat(F.lit("<p>Of <b>"), "c_mktsegment", F.lit("</b></p>")).alias("entry"),
        F.array(F.struct((F.col("c_custkey") + 25).alias("target_id"), F.lit("Leads").alias("relation")), F.struct(F.col("c_custkey").alias("target_id"), F.lit("Likes").alias("relation"))).alias("relations"),
    )
    return c.groupBy(F.concat(F.lit("nation"), "c_nationkey", F.lit(".json")).alias("path")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", record.alias("r")))), lambda x: x["r"])).alias("content"))


QUERIES["record_entities"] = lambda spark, d: connectors.records(export_records(spark, d))[0].select("path", "type", "name", "summary")
SQL["record_entities"] = "select 'nation' || c_nationkey || '.json' as path, case c_custkey % 3 when 0 then 'character' else 'faction' end as type, c_name as name, 'Of ' || c_mktsegment as summary from customer where c_custkey % 3 < 2"
QUERIES["record_relations"] = lambda spark, d: connectors.records(export_records(spark, d))[1].select("path", "label", "inverse", (F.col("source") == F.col("target")).cast("int").alias("own"))
SQL["record_relations"] = """
with c as (select * from customer where c_custkey % 3 < 2) select 'nation' || c_nationkey || '.json' as path, 'likes' as label, 'likes' as inverse, 1 as own from c
union all select 'nation' || a.c_nationkey || '.json', 'leads', 'led by', 0 from c a join c b on b.c_custkey = a.c_custkey + 25 and a.c_nationkey = b.c_nationkey"""


def pairs(spark, d):
    p = table(spark, d, "pages")
    facts = p.select(F.concat(F.lit("json/p"), "page_id", F.lit(".json")).alias("path"), F.to_json(F.struct(F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("Page "), "page_id")).alias("title"), F.when(F.col("page_id") % 3 == 0, "Settlement").alias("template"))).alias("content"))
    shown = p.where("page_id % 5 > 0").select(F.concat(F.lit("html/p"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return connectors.paired(facts.unionByName(shown)).select("path", "type", "name", F.md5("summary").alias("digest"))


QUERIES["paired_export"] = pairs
_B = r"[\s\x0B\p{Z}\x{FEFF}]"
SQL["paired_export"] = f"""
select 'json/p' || page_id || '.json' as path, case when page_id % 3 = 0 then 'place' else 'character' end as type, 'Page ' || page_id as name, md5(case when page_id % 5 > 0 then regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_B}+', ' ', 'g'), '^ +| +$', '', 'g')
  else 'Page ' || page_id || ', from json/p' || page_id || '.json.' end) as digest from pages where page_id % 4 > 0"""


def free(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("/world/"), F.when(F.col("doc_id") % 3 == 0, "Places").otherwise("people"), F.lit("/d"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.when(F.col("doc_id") % 2 == 0, "---\nk: v\n---\n## The [[Name|n]]\n").otherwise(""), F.lit("Key:: value\n\n[[Linked|shown]] first line\n"), "text").alias("content"))
    return connectors.free_texts(docs)


QUERIES["free_texts"] = free
SQL["free_texts"] = """
select '/world/' || case when doc_id % 3 = 0 then 'Places' else 'people' end || '/d' || doc_id || '.md' as path, case when doc_id % 3 = 0 then 'place' else 'character' end as type, case when doc_id % 2 = 0 then 'The [[Name|n]]' when regexp_matches(text, '(?m)^[ \\t]*#') then null else 'd' || doc_id end as name, 'Linked first line' as summary from documents"""


def round_trip(spark, d):
    """Customers as exported markdown, read back."""
    rows = spread(table(spark, d, "customer").select("c_name", "c_mktsegment")).select(
        F.col("c_name").alias("name"), F.lit("character").alias("type"), F.array("c_mktsegment", F.lit('say "x"')).alias("aliases"), fn.slug(F.col("c_name")).alias("slug"), F.lit("players").alias("visibility"), F.lit("2026-01-01T00:00:00.000Z").alias("created_at"), F.lit(None).cast("string").alias("updated_at"), F.concat(F.lit("Body\n---\n\nof "), "c_name").alias("body")
    )
    return connectors.parsed_markdown(connectors.entry_markdown(rows)).select("slug", "name", F.array_join("aliases", "|").alias("aliases"), "updated_at", "body", "error")


QUERIES["exported_entries"] = round_trip
SQL["exported_entries"] = """
select lower(replace(c_name, '#', '-')) as slug, c_name as name, c_mktsegment || '|say "x"' as aliases, null as updated_at, 'Body' || chr(10) || '---' || chr(10) || chr(10) || 'of ' || c_name as body, null as error from customer"""


def kinds(spark, d):
    """Archives by what their paths look like: one for each user, with paths by the numbers of its events."""
    shapes = ["notes/a.md", "json/a.json", "html/a.html", "page.html", "page_files/x.png", "b.md", "vault/.obsidian/app.json", "one.pdf"]
    rows = events(spark, d).select("user_id", F.get(F.array(*map(F.lit, shapes)), (F.col("k") + F.col("user_id")).cast("int") % 8).alias("path")).distinct()
    return archives.source_types(rows, "user_id")


QUERIES["source_types"] = kinds
SQL["source_types"] = f"""
with {_E}, p as (select distinct user_id, (['notes/a.md', 'json/a.json', 'html/a.html', 'page.html', 'page_files/x.png', 'b.md', 'vault/.obsidian/app.json', 'one.pdf'])[(k + user_id) % 8 + 1] as path from e),
f as (select user_id, list(path) as l, count(*) as n from p group by user_id), m as (select *, len(list_filter(l, lambda x: x like '%.md')) as md, len(list_filter(l, lambda x: x like '%.html')) as pages from f),
r as (select *, case when list_contains(l, 'vault/.obsidian/app.json') then 1 when list_contains(l, 'json/a.json') and list_contains(l, 'html/a.html') then 2 when list_contains(l, 'page.html') and list_contains(l, 'page_files/x.png') then 3 when md = n then 4 when n = 1 and list_contains(l, 'one.pdf') then 5 else 6 end as rule from m)
select user_id, (['obsidian', 'world-anvil', 'onenote', 'obsidian', 'pdf', 'generic'])[rule] as kind, rule in (1, 2, 3, 5) as confident, case rule when 1 then md when 3 then pages when 4 then md else n end as n from r"""
QUERIES["alias_ranks"] = lambda spark, d: browse.ranked_aliases(table(spark, d, "part").select("p_partkey", "p_name", F.array("p_type", "p_brand", F.concat("p_brand", F.lit(" old"))).alias("aliases")), "p_name", "aliases", "brand#1", 40, "p_partkey").select("p_partkey", "rank", "matched_alias")
SQL["alias_ranks"] = """
with p as (select p_partkey, p_name, [p_type, p_brand, p_brand || ' old'] as a from part), f as (select * from p where p_name ilike '%brand#1%' or len(list_filter(a, lambda x: x ilike '%brand#1%')) > 0)
select p_partkey, case when lower(p_name) = 'brand#1' then 0 when p_name ilike 'brand#1%' then 1 when list_contains(list_transform(a, lambda x: lower(x)), 'brand#1') then 2 when len(list_filter(a, lambda x: x ilike 'brand#1%')) > 0 then 3 else 4 end as rank, case when a[2] ilike 'brand#1%' then a[2] end as matched_alias from f order by rank, p_name, p_partkey limit 40"""
QUERIES["name_completions"] = lambda spark, d: browse.completions(table(spark, d, "part").select("p_partkey", "p_name", F.array("p_brand").alias("aliases")), "p_name", "aliases", " Co ", 30, "p_partkey").select("p_partkey", "p_name")
SQL["name_completions"] = "select p_partkey, p_name from part where contains(lower(p_name), 'co') or contains(lower(p_brand), 'co') order by not starts_with(lower(p_name), 'co'), p_name, p_partkey limit 30"


def feed(spark, d):
    """The newest ten of orders and events together, oldest first."""
    orders = table(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    acts = table(spark, d, "events").select(F.col("ts").alias("at"), F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    newest = browse.newest([orders, acts], [F.desc("at"), F.desc("id")], 10)
    return newest.orderBy("at", "id").select("kind", "id")


QUERIES["newest_first"] = feed
SQL["newest_first"] = "select kind, id from (select o_orderdate as w, 'order' as kind, o_orderkey as id from orders union all select ts, 'event', event_id from events order by w desc, id desc limit 10)"
QUERIES["attempt_order"] = lambda spark, d: events(spark, d).withColumn("tier", F.get(F.array(F.lit("media"), F.lit("text"), F.lit("draft")), F.col("k") % 3)).orderBy(browse.ordinal("tier", ["text", "draft", "media"]), "event_id").limit(50).select("event_id", "tier")
SQL["attempt_order"] = f"with {_E} select event_id, (['media', 'text', 'draft'])[k % 3 + 1] as tier from e order by case k % 3 when 1 then 0 when 2 then 1 else 2 end, event_id limit 50"
QUERIES["global_first"] = lambda spark, d: table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").orderBy(F.col("quality").isNull().desc(), "source", "doc_id").limit(50).select("doc_id", "quality")
SQL["global_first"] = "select doc_id, quality from documents left join labels using (doc_id) order by quality is null desc, source nulls first, doc_id limit 50"


def spending(spark, d):
    """Each user's events as steps of a job that may cost 900: what does not fit is rejected, and the next one may."""
    from ..operators import writes

    steps = table(spark, d, "events").select("user_id", "event_id", "value", F.lit(900.0).alias("budget"))
    return writes.spent(steps, "user_id", "event_id", "value", "budget").select("event_id", F.col("accepted").cast("int").alias("accepted"), F.round("spent", 4).alias("spent"))


QUERIES["budgeted_spend"] = spending
SQL["budgeted_spend"] = """
with recursive s as (select *, row_number() over (partition by user_id order by event_id) as n from events),
w(user_id, n, event_id, accepted, spent) as (select user_id, 0, null::bigint, false, 0::double from (select distinct user_id from events)
  union all select w.user_id, s.n, s.event_id, w.spent + s.value <= 900, w.spent + case when w.spent + s.value <= 900 then s.value else 0 end from w join s on s.user_id = w.user_id and s.n = w.n + 1)
select event_id, accepted::int as accepted, round(spent, 4) as spent from w where n > 0"""


def gates(spark, d):
    """Steps that may run: the worst case is twice the cost, purchases propose, the reserve may be drawn on once before that."""
    from ..operators import writes

    steps = events(spark, d).select("user_id", "event_id", (F.col("value") * 2).alias("worst"), F.col("value").alias("cost"), (F.col("event_type") == "purchase").alias("proposes"), (F.col("user_id") * 40.0).alias("budget"), F.lit(150.0).alias("reserve"))
    return writes.gated(steps, "user_id", "event_id", "worst", "cost", "proposes", "budget", "reserve").groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("steps"))


QUERIES["budget_gates"] = gates
SQL["budget_gates"] = """
with recursive s as (select *, row_number() over (partition by user_id order by event_id) as n, user_id * 40.0::double as budget from events),
w(user_id, n, used, proposed, drawn, ended) as (select user_id, 0, 0::double, false, false, false from (select distinct user_id from events)
  union all select user_id, n, case when ended then used else used + value end, proposed or (not ended and event_type = 'purchase'), drawn, ended from (
    select w.user_id, s.n, w.used, s.value, s.event_type, w.proposed, w.drawn or (not w.ended and w.used + 2 * s.value > s.budget and not w.proposed and not w.drawn and w.used + 2 * s.value <= s.budget + 150) as drawn,
      w.ended or not (w.used + 2 * s.value <= s.budget or (not w.proposed and not w.drawn and w.used + 2 * s.value <= s.budget + 150)) as ended from w join s on s.user_id = w.user_id and s.n = w.n + 1))
select user_id, count(*) filter (n > 0 and not ended) as allowed, count(*) filter (n > 0) as steps from w group by user_id"""


def canonical(spark, d):
    """Numbered texts as JSON with keys in any order, brought to one form."""
    from ..operators import writes

    json = F.concat(F.lit('{ "z": '), F.col("k"), F.lit(', "a": {"c": ['), F.col("user_id"), F.lit('.0, null], "b": "é'), F.col("event_type"), F.lit('"} }'))
    return events(spark, d).select("event_id", writes.canonical_json(F.when(F.col("k") % 9 == 0, "{").otherwise(json)).alias("json"))


QUERIES["canonical_json"] = canonical
SQL["canonical_json"] = f"""with {_E} select event_id, case when k % 9 > 0 then '{{"a":{{"b":"é' || event_type || '","c":[' || user_id || ',null]}},"z":' || k || '}}' end as json from e"""


def keyed_paths(spark, d):
    """Paths of labels in JSON as paths of keys: a part's own brand before those of others."""
    from ..operators import writes

    p = table(spark, d, "part")
    types = p.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("nth")).select("label", fn.derived_key(F.col("label")).alias("key"), F.when(F.col("nth") % 2 == 0, "mine").alias("owner"), "nth")
    twice = types.unionByName(types.select("label", F.concat("key", F.lit("_own")).alias("key"), F.lit("mine").alias("owner"), (F.col("nth") + 1000).alias("nth")))
    rows = p.select(F.col("p_partkey").alias("id"), F.to_json(F.array("p_name", F.lit("unknown label"), "p_name")).alias("path"))
    return writes.keyed(rows, "id", "path", twice)


QUERIES["keyed_paths"] = keyed_paths
SQL["keyed_paths"] = """
with t as (select p_name, min(p_partkey) % 2 = 0 as mine from part group by 1), k as (select p_name, replace(p_name, ' ', '_') || case when mine then '' else '_own' end as key from t)
select p_partkey as id, '["' || key || '","unknown label","' || key || '"]' as path from part join k using (p_name)"""


def cleaned(spark, d):
    text = F.concat(F.lit("&lt;b&gt; &#233;&#x41;&nope; &amp;amp; "), "text")
    return table(spark, d, "benchmark").select("item_id", archives.entities_decoded(text).alias("text"))


QUERIES["decoded_entities"] = cleaned
SQL["decoded_entities"] = "select item_id, '<b> éA&nope; &amp; ' || text as text from benchmark"


def warm(spark, d):
    """What signups (prep), views (opening), clicks (consumption) and purchases (nightly) ask to be warmed, over the relations by errors."""
    from ..operators import writes

    e = events(spark, d)
    trigger = F.when(F.col("event_type") == "signup", "prep").when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "consumption").when(F.col("event_type") == "purchase", "nightly")
    start = e.select((F.col("user_id") % 5).alias("universe"), F.col("k").alias("entity"), trigger.alias("trigger")).where("trigger is not null")
    ring = e.where("event_type = 'error'").select((F.col("user_id") % 5).alias("universe"), F.col("k").alias("entity"), ((F.col("k") * 7 + 1) % 100).alias("near"), (F.col("k") % 2 + 1).alias("depth"))
    rates = e.groupBy((F.col("user_id") % 5).alias("universe")).agg(F.max("k").alias("m")).select("universe", F.when(F.col("universe") < 2, 0.1).when(F.col("universe") < 4, 0.5).alias("rate"))
    return writes.warmed(start, ring, rates, e.where("user_id % 5 < 3").select((F.col("user_id") % 5).alias("universe"))).groupBy("universe", "trigger").agg(F.count("*").alias("n"), F.sum("entity").alias("ids"))


QUERIES["warm_triggers"] = warm
SQL["warm_triggers"] = f"""
with {_E}, s as (select user_id % 5 as u, k as x, case event_type when 'signup' then 'prep' when 'view' then 'open' when 'click' then 'consumption' when 'purchase' then 'nightly' end as t from e where event_type <> 'error'),
r as (select user_id % 5 as u, k as x, (k * 7 + 1) % 100 as near, k % 2 + 1 as depth from e where event_type = 'error'),
w as (select u, x, t from s where t <> 'nightly' or u < 3 union select s.u, near, t from s join r on r.u = s.u and r.x = s.x where t = 'consumption' and depth <= case when s.u < 2 then 1 else 2 end)
select u as universe, t as trigger, count(*) as n, sum(x)::bigint as ids from w group by 1, 2"""
