"""Queries over text functions. Every query reads whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language
from ..functions import text as fn
from ..functions.words import MARKERS, SCENE_STOP
from ..operators import passages, proposals
from ..sources import spread, table

QUERIES, SQL = {}, {}
_FOLD = r"lower(regexp_replace(strip_accents(%s), '[\^`]', '', 'g'))"
_SLUG = f"regexp_replace(regexp_replace({_FOLD % 'text'}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_FORM = f"trim(regexp_replace({_FOLD % '%s'}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
_KEY = "regexp_replace(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_BLANK = r"[\s\x0B\p{Z}\x{FEFF}]"


def _trim(x):
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def documents(spark, d):
    return spread(table(spark, d, "documents"))


text = "text"
QUERIES["slugs"] = lambda spark, d: table(spark, d, "benchmark").select("item_id", fn.slug(text).alias("slug"))
SQL["slugs"] = f"select item_id, case when coalesce({_SLUG}, '') = '' then 'entry' else {_SLUG} end as slug from benchmark"
QUERIES["match_forms"] = lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", fn.match_form(text).alias("form"), fn.derived_key(text).alias("key"), fn.label_key(text).alias("label"))
SQL["match_forms"] = f"select conv_id, turn, {_FORM % 'text'} as form, {_KEY} as key, regexp_replace(lower(trim(text, ' ')), '\\s+', ' ', 'g') as label from conversations"
QUERIES["text_forms"] = lambda spark, d: documents(spark, d).select("doc_id", fn.slug(text).alias("slug"), fn.match_form(text).alias("form"), fn.derived_key(text).alias("key"))
SQL["text_forms"] = f"select doc_id, case when coalesce({_SLUG}, '') = '' then 'entry' else {_SLUG} end as slug, {_FORM % 'text'} as form, {_KEY} as key from documents"
QUERIES["unique_slugs"] = lambda spark, d: fn.unique_slugs(table(spark, d, "part").withColumn("base", fn.slug(F.col("p_name"))), "p_type", "base", ["p_partkey"]).select("p_partkey", "slug")
SQL["unique_slugs"] = """
with s as (select p_partkey, replace(p_name, ' ', '-') as base, row_number() over (partition by p_type, p_name order by p_partkey) as n from part)
select p_partkey, case when n = 1 then base when n <= 99 then base || '-' || n end as slug from s"""
_STEM = "case when length(w) > 5 and w like '%ing' then w[:-4] when length(w) > 4 and w like '%ed' then w[:-3] when length(w) > 3 and w like '%s' and w not like '%ss' then w[:-2] else w end"
QUERIES["relation_labels"] = lambda spark, d: table(spark, d, "benchmark").select("item_id", fn.relation_label(text).alias("label"))
SQL["relation_labels"] = f"select item_id, array_to_string(list_transform(string_split({_FORM % 'text'}, ' '), lambda w: {_STEM}), ' ') as label from benchmark"
QUERIES["token_counts"] = lambda spark, d: documents(spark, d).select("doc_id", F.size(fn.ascii_words(text)).alias("ascii_words"), F.size(fn.unicode_words(text)).alias("unicode_words"), fn.token_estimate(text).alias("tokens"))
SQL["token_counts"] = """
select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')))::int as ascii_words, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')))::int as unicode_words,
  ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0)::int as tokens from documents"""


def word_kinds(spark, d):
    words = [fn.content_words(text, "en"), fn.content_words(text, "it"), fn.scene_words(text)]
    return documents(spark, d).select("doc_id", *[F.array_join(F.array_sort(w), " ").alias(n) for w, n in zip(words, ("english", "italian", "scene"), strict=True)])


QUERIES["word_kinds"] = word_kinds
_SAID = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))"


def _quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SQL["word_kinds"] = f"""
select doc_id, array_to_string(list_sort(list_filter({_SAID}, lambda w: not list_contains([{_quoted(fn.function_tokens("en"))}], w))), ' ') as english, array_to_string(list_sort(list_filter({_SAID}, lambda w: not list_contains([{_quoted(fn.function_tokens("it"))}], w))), ' ') as italian,
  array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: length(w) >= 4 and not list_contains([{_quoted(SCENE_STOP)}], w))), ' ') as scene from documents"""


def first_paragraph(spark, d):
    return documents(spark, d).select("doc_id", fn.excerpt(text).alias("excerpt"), fn.trimmed_excerpt(text).alias("trimmed"))


QUERIES["excerpts"] = first_paragraph
_FIRST, _WHOLE = _trim("string_split(text, chr(10) || chr(10))[1]"), _trim("text")
SQL["excerpts"] = f"""
with p as (select doc_id, {_FIRST} as first, {_WHOLE} as whole from documents)
select doc_id, case when length(first) > 160 then substring(first, 1, 160) || '…' else first end as excerpt, case when length(whole) > 160 then regexp_replace(substring(whole, 1, 160), '{_BLANK}+$', '') || '…' else whole end as trimmed from p"""
QUERIES["one_liners"] = lambda spark, d: documents(spark, d).select("doc_id", fn.one_line(text).alias("line"), fn.section_summary(text).alias("summary"))
_FLAT = _trim(f"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', '\\1', 'g'), '[#*_`>]+', ' ', 'g'), '{_BLANK}+', ' ', 'g')")
SQL["one_liners"] = f"""
with f as (select doc_id, text, {_FLAT} as flat from documents), s as (select *, trim(regexp_extract(flat, '^(.*?[.!?])(?: |$)', 1), ' ') as s, {_trim("regexp_extract(" + _WHOLE + ", '^([^.!?]*[.!?])', 1)")} as head from f), c as (select *, case when s <> '' then s else flat end as c from s)
select doc_id, case when flat = '' then null when length(c) > 200 then rtrim(substring(c, 1, 200), ' ') || '...' else c end as line, case when head <> '' then head else substring({_WHOLE}, 1, 160) end as summary from c"""
def marked_text():
    return F.concat(F.lit("## Title\n\n"), text, F.lit("\n\n> A [[Linked Name]] and [[Other#part|label]] with ![alt](pic.png =150%) and [shown](http://x.y) *here*.\n:::secret\nhidden [[Secret]]\n:::\n- item ![b](c.png)"))


_MARKED = "'## Title' || chr(10) || chr(10) || text || chr(10) || chr(10) || '> A [[Linked Name]] and [[Other#part|label]] with ![alt](pic.png =150%) and [shown](http://x.y) *here*.' || chr(10) || ':::secret' || chr(10) || 'hidden [[Secret]]' || chr(10) || ':::' || chr(10) || '- item ![b](c.png)'"


def marked(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", marked_text().alias("text"))


QUERIES["previews"] = lambda spark, d: marked(spark, d).select("conv_id", "turn", fn.preview(text).alias("preview"))
SQL["previews"] = rf"""
with m as (select conv_id, turn, {_MARKED} as t from conversations), a as (select *, regexp_replace(regexp_replace(t, '(?s):::secret.*?\n:::\n', '', 'g'), '\[\[([^\]\n]+)\]\]', '\1', 'g') as p from m),
b as (select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(p, '(?m)^[ \t]{{0,3}}(?:-{{3,}}|\*{{3,}}|_{{3,}})[ \t]*$', ' ', 'g'), '!\[[^\]\n]*\]\([^)\n]*\)', ' ', 'g'), '\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g') as p from a),
c as (select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(p, '(?m)^[ \t]{{0,3}}#{{1,6}}[ \t]+', '', 'g'), '(?m)^[ \t]{{0,3}}>[ \t]?', '', 'g'), '(?m)^[ \t]{{0,3}}(?:[-*+]|[0-9]+[.)])[ \t]+', '', 'g') as p from b),
e as (select conv_id, turn, {_trim("regexp_replace(regexp_replace(p, '[*][*]|__|~~|`+|[*_]', '', 'g'), '" + _BLANK + "+', ' ', 'g')")} as p from c),
f as (select *, substring(p, 1, 200) as cut, length(regexp_extract(substring(p, 1, 200), '(?s)^(.*) ', 1)) as last from e)
select conv_id, turn, case when length(p) <= 200 then p else rtrim(case when last > 120 then substring(cut, 1, last) else cut end, ' ') || '…' end as preview from f"""
QUERIES["links_and_images"] = lambda spark, d: marked(spark, d).select(
    "conv_id", "turn", F.array_join(fn.wikilinks(text), ";").alias("links"), F.array_join(F.transform(fn.images(text), lambda i: F.concat_ws("|", i["alt"], i["url"], i["width"].cast("string"))), ";").alias("images"), fn.without_link_marks(text).alias("plain")
)
SQL["links_and_images"] = rf"""
with m as (select conv_id, turn, {_MARKED} as t from conversations)
select conv_id, turn, 'Linked Name;Other;Secret' as links, 'alt|pic.png|100;b|c.png' as images, regexp_replace(t, '\[\[([^\]\n]+)\]\]', '\1', 'g') as plain from m"""
QUERIES["fence_views"] = lambda spark, d: (
    documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.length(fn.without_fences(F.concat(F.when(F.col("toxic") == 1, F.concat(F.lit(":::secret\n"), "text", F.lit("\n:::\n"))).otherwise(F.col("text")), F.lit("end")))).alias("shown"))
)
SQL["fence_views"] = "select doc_id, case when toxic = 1 then 3 else length(text) + 3 end as shown from documents left join labels using (doc_id)"


def spans(spark, d):
    """Whether the span from the middle of each marked turn to its link, and the one of its last line, touch a secret; and what they say."""
    rows = marked(spark, d).withColumn("end", F.length("text")).withColumn("link", F.call_function("locate", F.lit("[[Linked"), text) - 1)
    seen = lambda a, b: fn.visible_span(text, a, b).cast("int")
    whole = fn.span_text(text, F.col("link"), F.col("end"))
    return rows.select("conv_id", "turn", seen(F.lit(3), F.col("link")).alias("before"), seen(F.col("link"), F.col("end")).alias("over"), seen(F.col("end") - 17, F.col("end")).alias("behind"), F.md5(whole).alias("digest"), fn.span_text(text, F.lit(5), F.lit(5)).alias("none"))


QUERIES["secret_spans"] = spans
SQL["secret_spans"] = f"with m as (select conv_id, turn, {_MARKED} as t from conversations) select conv_id, turn, 1 as before, 0 as over, 1 as behind, md5(substring(t, position('[[Linked' in t))) as digest, null as none from m"


def located(spark, d):
    """Where the sentences of each benchmark passage stand in it."""
    rows = table(spark, d, "benchmark").select("item_id", "text", F.posexplode(fn.sentences(text)).alias("nth", "sentence"))
    at = fn.locate_span(text, F.col("sentence"))
    return rows.select("item_id", "nth", F.length("sentence").alias("size"), at["start"].alias("start"), at["end"].alias("end"), F.md5("sentence").alias("digest"))


QUERIES["located_sentences"] = located
# white space in the passages is single blanks and line feeds, so a sentence has the length of its place
_UNITS = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({_trim('text')}, '\\s*\\n\\s*', ' ', 'g'), '([.!?])\\s+([A-Z0-9\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {_trim('s')}), lambda s: s <> '')"
SQL["located_sentences"] = f"""
with u as (select item_id, regexp_replace(text, '\\n', ' ', 'g') as flat, unnest({_UNITS}) as s, generate_subscripts({_UNITS}, 1) - 1 as nth from benchmark)
select item_id, nth, length(s) as size, position(s in flat) - 1 as start, position(s in flat) - 1 + length(s) as "end", md5(s) as digest from u"""
QUERIES["sentence_digests"] = lambda spark, d: documents(spark, d).select("doc_id", F.size(fn.sentences(text)).alias("n"), F.md5(F.array_join(fn.sentences(text), "|")).alias("digest"))
# each line on its own, blank and heading lines marked as breaks, the rest joined
_LINES = f"list_transform(string_split(regexp_replace(text, '\\r\\n', chr(10), 'g'), chr(10)), lambda x: {_trim('x')})"
_PARAS = f"string_split(array_to_string(list_transform({_LINES}, lambda x: case when x = '' then chr(2) when regexp_matches(x, '^#{{1,6}}[ \\t]+') then chr(2) || x || chr(2) else x end), ' '), chr(2))"
_ALL = f"list_filter(list_transform(flatten(list_transform({_PARAS}, lambda p: case when regexp_matches({_trim('p')}, '^#{{1,6}}[ \\t]+') then [p] else string_split(regexp_replace({_trim('p')}, '([.!?])\\s+([A-Z0-9\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) end)), lambda s: {_trim('s')}), lambda s: s <> '')"
SQL["sentence_digests"] = f"select doc_id, len({_ALL})::int as n, md5(array_to_string({_ALL}, '|')) as digest from documents"
QUERIES["languages"] = lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", language.detected(text).alias("language"))


def _decide(en, it, words, least):
    return f"case when {words} >= {least} and greatest({en}, {it}) >= 2 and greatest({en}, {it}) >= least({en}, {it}) * 1.5 then case when {en} >= {it} then 'en' else 'it' end end"


def _hits(tokens, locale):
    return f"len(list_filter({tokens}, lambda t: t[1] = lower(t[1]) and list_contains([{_quoted(MARKERS[locale])}], lower(t))))"


_TOK = r"list_filter(regexp_split_to_array(%s, '[^\p{L}\p{M}]+'), lambda t: t <> '')"
SQL["languages"] = rf"""
with s as (select conv_id, turn, text, {_TOK % "text"} as w, unnest(string_split(regexp_replace(text, '([.!?;:\n])\s+', '\1' || chr(1), 'g'), chr(1))) as part from conversations),
p as (select conv_id, turn, text, w, {_TOK % "part"} as q from s),
v as (select conv_id, turn, any_value(w) as w, list({_decide(_hits("q", "en"), _hits("q", "it"), "len(q)", 5)}) as votes from p group by conv_id, turn, text),
g as (select *, {_decide(_hits("w", "en"), _hits("w", "it"), "len(w)", 8)} as whole, len(list_filter(votes, lambda x: x is not null)) as n from v)
select conv_id, turn, case when n > 1 and len(list_filter(votes, lambda x: x <> whole)) / n::double >= 0.25 then null else whole end as language from g"""
HEADERS = ["it-CH, en;q=0.9", "de, fr;q=0.8", "en;q=0, it;q=0.1", "fr;q=0.9, *, it", "en;q=0.2,it;q=0.2", "it;q=x, en-GB;q=0.5", ""]


def reader_languages(spark, d):
    rows = table(spark, d, "events").select("event_id", F.get(F.array(*map(F.lit, HEADERS)), (F.col("event_id") % 8).cast("int")).alias("h"), F.when(F.col("event_id") % 5 == 0, "it_CH").alias("p"), F.when(F.col("event_id") % 7 == 0, "xx").alias("c"))
    stored = language.kept_language(F.lit("de"), F.when(F.col("event_id") % 2 == 0, "human").otherwise("detected"), F.col("p"))
    return rows.select("event_id", language.negotiated(F.col("p"), F.col("c"), F.col("h")).alias("locale"), stored.alias("stored"))


QUERIES["reader_languages"] = reader_languages
SQL["reader_languages"] = """
select event_id, case when event_id % 5 = 0 then 'it' else ['it', 'en', 'it', 'en', 'en', 'en', 'en', 'en'][event_id % 8 + 1] end as locale, case when event_id % 2 = 0 then 'de' when event_id % 5 = 0 then 'it_CH' end as stored from events"""
QUERIES["writing_languages"] = lambda spark, d: table(spark, d, "documents").select("doc_id", language.writing_language(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, "it-IT"), F.lit(None).cast("string")).alias("language"))
SQL["writing_languages"] = "select doc_id, coalesce(case when doc_id % 3 = 0 and lang in ('en', 'it') then lang end, case when doc_id % 2 = 0 then 'it' end, 'en') as language from documents"
QUERIES["safe_topics"] = lambda spark, d: documents(spark, d).select("doc_id", fn.safe_topic(F.concat(F.when(F.col("doc_id") % 4 == 0, "Found 40 % of it: ").otherwise("inconsistently "), "text")).cast("int").alias("safe"))
SQL["safe_topics"] = r"""
select doc_id, (not regexp_matches(case when doc_id % 4 = 0 then 'Found 40 % of it: ' else 'inconsistently ' end || text, '(?i)contradiction detected|error:|[0-9]+\s*%|\bconsistent\b|\binconsistent\b|no conflicts? found|fix this automatically'))::int as safe from documents"""
QUERIES["wikitexts"] = lambda spark, d: table(spark, d, "benchmark").select("item_id", F.md5(fn.wikitext(F.concat(F.lit("== H ==\n'''Bold''' <!-- no -->{{a|{{b}}}}[[File:x.png]]\n"), text, F.lit(" [[Target|shown]] [https://a.b c d]&nbsp;<ref name=\"x\"/>end<ref>gone</ref>")))).alias("digest"))
SQL["wikitexts"] = f"select item_id, md5({_trim("'== H ==' || chr(10) || 'Bold ' || chr(10) || regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') || ' shown c d end'")}) as digest from benchmark".replace("'Bold ' ||", "'Bold' ||")
QUERIES["markdown_chunks"] = lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select(
    "conv_id", F.inline(fn.markdown_sections(F.concat(F.lit("c"), "conv_id"), F.lit("Talk"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("## Turn "), x["turn"].cast("string"), F.lit("\n\n"), x["text"])), "\n\n")))
).select("id", "breadcrumb", F.md5("text").alias("digest"))
SQL["markdown_chunks"] = f"""
select 'c' || conv_id || '#' || (row_number() over (partition by conv_id order by turn, text) - 1) as id, 'Talk > Turn ' || turn as breadcrumb, md5({_trim("text")}) as digest from conversations"""


def html_sources(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(fn.without_presentation(F.col("html"))).alias("digest"))


QUERIES["html_sources"] = html_sources
SQL["html_sources"] = r"""
select page_id, md5(regexp_replace(regexp_replace(html, '(?i)<style\b[^>]*>[\s\S]*?</style>', '', 'g'), '(?i)\s(?:style|class|lang)\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>]+)', '', 'g')) as digest from pages"""
_BODY = "html"
for _pattern, _sign in fn.HTML_STEPS:
    _quote = "chr(10)" if _sign == "\n" else "'" + _sign.replace("'", "''") + "'"
    _BODY = f"regexp_replace({_BODY}, '{_pattern.replace("'", "''")}', {_quote}, 'g')"
_TITLE = _trim("regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1)")
_SHOWN = f"with t as (select page_id, case when {_TITLE} <> '' then '# ' || {_TITLE} || chr(10) || {_BODY} else {_BODY} end as shown from pages)"
QUERIES["page_texts"] = lambda spark, d: table(spark, d, "pages").select("page_id", F.length(fn.html_text(F.col("html"))).alias("n_chars"), F.md5(fn.html_text(F.col("html"))).alias("digest"))
SQL["page_texts"] = f"{_SHOWN} select page_id, length(shown)::int as n_chars, md5(shown) as digest from t"
QUERIES["plain_pages"] = lambda spark, d: table(spark, d, "pages").select("page_id", F.length(fn.plain_html(F.col("html"))).alias("n_chars"), F.md5(fn.plain_html(F.col("html"))).alias("digest"))
_SQUEEZED = "array_to_string(list_filter(list_transform(string_split(shown, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))"
SQL["plain_pages"] = f"{_SHOWN} select page_id, length({_SQUEEZED})::int as n_chars, md5({_SQUEEZED}) as digest from t"
QUERIES["benchmark_mentions"] = lambda spark, d: passages.contained(documents(spark, d).select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")), "text", "passage").select("doc_id", "item_id")
SQL["benchmark_mentions"] = "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) where length(b.text) > 0"
QUERIES["document_proposals"] = lambda spark, d: proposals.proposed(documents(spark, d), "doc_id", "text").select("doc", "nth", "subject", F.md5("statement").alias("statement"))
SQL["document_proposals"] = f"""
with l as (select doc_id::varchar as doc, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents), t as (select doc, n, {_trim("line")} as x from l),
s as (select *, last_value(case when starts_with(x, '#') then {_trim("ltrim(x, '#')")} end ignore nulls) over (partition by doc order by n rows between unbounded preceding and current row) as subject from t),
m as (select doc, subject, x, min(n) as n from s where x <> '' and not starts_with(x, '#') group by all)
select doc, (row_number() over (partition by doc order by n))::int as nth, subject, md5(x) as statement from m
union all select doc, 1, max_by(subject, n), null from s group by doc having count(*) filter (x <> '' and not starts_with(x, '#')) = 0"""
QUERIES["page_chunks"] = lambda spark, d: passages.chunked(table(spark, d, "pages").select("page_id", F.concat(F.lit("Page "), "page_id").alias("title"), fn.html_text(F.col("html")).alias("text")), "page_id", "title", "text", 60)
