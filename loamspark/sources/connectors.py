"""Exports of other tools as tables of entities and relations, and the markdown export with its reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions import text as fn

# What the types, relations and templates of exports become.
RECORD_TYPES = {"character": "character", "location": "place", "organisation": "faction", "family": "faction", "item": "item", "event": "event", "journal": "session", "quest": "event"}
RECORD_RELATIONS = {"protects": "protected by", "leads": "led by", "rival": "rival", "reports to": "commands"}
TEMPLATES = {
    "settlement": "place", "location": "place", "condition": "event", "organization": "faction", "organisation": "faction",
    "character": "character", "person": "character", "item": "item", "document": "item",
}
RECORD = "array<struct<entity_id:string,entity_type:string,name:string,entry:string,relations:array<struct<target_id:string,relation:string>>>>"


def stripped(html: Column) -> Column:
    """HTML without tags, white space collapsed."""
    return fn.trimmed(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), rf"{fn.BLANK}+", " "))


def records(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of documents (path, content) that are JSON arrays of records.

    entities: path, local, type, name, summary. Records of unmapped types or without a name are left out; a text that is no array has none.
    relations: path, source, target, label, inverse, between entities of one document. Of records with one entity_id the last is the target.
    """
    rows = documents.select("path", F.posexplode(F.from_json("content", RECORD)).alias("local", "r")).where("r is not null")
    kind = predicates.lookup(RECORD_TYPES, F.col("r.entity_type"))
    known = rows.withColumn("type", kind).where((F.coalesce(F.col("r.name"), F.lit("")) != "") & F.col("type").isNotNull())
    summary = F.when(F.coalesce(F.col("r.entry"), F.lit("")) != "", stripped(F.col("r.entry"))).otherwise(F.concat(F.col("r.name"), F.lit(" appears in this export.")))
    entities = known.select("path", "local", "type", F.col("r.name").alias("name"), summary.alias("summary"))
    targets = known.where("r.entity_id is not null").groupBy("path", F.col("r.entity_id").alias("target_id")).agg(F.max("local").alias("target"))
    ids = targets.select("path", F.col("target_id").alias("own_id"))
    own = rows.select("path", F.col("local").alias("source"), F.col("r.entity_id").alias("own_id"), F.explode("r.relations").alias("e")).join(ids, ["path", "own_id"], "left_semi")
    edges = own.select("path", "source", F.col("e.target_id").alias("target_id"), F.lower("e.relation").alias("label")).where("label <> ''").join(targets, ["path", "target_id"])
    inverse = F.coalesce(predicates.lookup(RECORD_RELATIONS, F.col("label")), F.col("label"))
    return entities, edges.select("path", "source", "target", "label", inverse.alias("inverse"))


def paired(documents: DataFrame) -> DataFrame:
    """path, type, name, summary of exports in which json/x.json describes html/x.html. A description without a title is left out; a page that is absent or empty gives a plain summary."""
    pages = documents.select(F.col("path").alias("_page"), stripped(F.col("content")).alias("_text")).where(F.col("_text") != "")
    facts = documents.where(F.lower("path").endswith(".json")).select("path", F.get_json_object("content", "$.title").alias("name"), F.get_json_object("content", "$.template").alias("_template"))
    page = F.regexp_replace(F.regexp_replace("path", "(?i)^json/", "html/"), r"(?i)\.json$", ".html")
    met = facts.where("name <> ''").withColumn("_page", page).join(pages, "_page", "left")
    kind = F.coalesce(predicates.lookup(TEMPLATES, F.lower("_template")), F.lit("character"))
    return met.select("path", kind.alias("type"), "name", F.coalesce("_text", F.concat("name", F.lit(", from "), "path", F.lit("."))).alias("summary"))


def type_from_path(path: Column) -> Column:
    has = lambda *parts: F.lower(path).rlike("/(" + "|".join(parts) + ")/")
    return F.when(has("locations", "places"), "place").when(has("factions", "organisations"), "faction").when(has("items"), "item").when(has("events", "sessions"), "event").otherwise("character")


def without_front(markdown: Column) -> Column:
    """Markdown without the block between dashes that it may begin with."""
    return F.regexp_replace(markdown, r"^---[\s\S]*?\n---[^\n]*(?:\n|\z)", "")


def free_texts(documents: DataFrame) -> DataFrame:
    """path, type, name, summary of plain documents (path, content): the first heading or the file's stem, and the first line of prose. Blank documents are left out.

    Prose is a line that is neither a heading nor an embedded file nor a field (words and two colons).
    """
    rows = documents.withColumn("_body", without_front(F.col("content"))).where(fn.trimmed(F.col("_body")) != "")
    first = lambda pattern: F.nullif(fn.trimmed(F.regexp_extract("_body", f"(?dm)^{fn.BLANK}*{pattern}", 1)), F.lit(""))
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z][A-Za-z0-9]{0,7}$", "")
    rows = rows.withColumn("name", F.when(F.regexp_like("_body", F.lit(f"(?dm)^{fn.BLANK}*#")), F.coalesce(first("#+([^\n]*)$"), F.lit(""))).otherwise(stem))
    prose = first(rf"(?!{fn.BLANK}|#|!\[\[|[A-Za-z ]+::)([^\n]+)$")
    said = F.regexp_replace(prose, r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1")
    return rows.select("path", type_from_path(F.col("path")).alias("type"), "name", F.coalesce(said, F.concat("name", F.lit(", from "), "path", F.lit("."))).alias("summary"))


FRONT = ("name", "type", "aliases", "slug", "visibility", "created_at", "updated_at")


def entry_markdown(rows: DataFrame) -> DataFrame:
    """slug, text: each entity as markdown with a front of JSON values. rows has FRONT (aliases an array, times texts) and body."""
    value = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")
    lines = [F.concat(F.lit(f"{c}: "), value(c)) for c in FRONT]
    return rows.select("slug", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), "body").alias("text"))


def parsed_markdown(files: DataFrame, text: str = "text") -> DataFrame:
    """files with FRONT, body and error: exported markdown read back. A text without a closed front, or a line in it that is no 'key: JSON', is an error."""
    close = F.call_function("locate", F.lit("\n---\n\n"), F.col(text))
    front = F.split(F.substring(F.col(text), F.lit(5), close - 5), "\n")
    bad = ~F.col(text).startswith("---\n") | (close == 0) | F.exists(front, lambda x: ~x.contains(": "))
    raw = F.map_from_entries(F.transform(front, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.regexp_replace(x, "^[^:]*: ", "").alias("v"))))
    rows = files.withColumn("_bad", bad).withColumn("_raw", F.when(~F.col("_bad"), raw))
    read = lambda c, t: F.from_json(F.concat(F.lit('{"v":'), F.col("_raw")[c], F.lit("}")), f"struct<v:{t}>")["v"].alias(c)
    body = F.when(~F.col("_bad"), F.substring(F.col(text), close + 6, F.length(text)))
    return rows.select(*files.columns, *[read(c, "array<string>" if c == "aliases" else "string") for c in FRONT if c not in files.columns], body.alias("body"), F.when(F.col("_bad"), "malformed front").alias("error"))


def vault(documents: DataFrame, excluded: tuple[str, ...] = (".obsidian", ".trash", ".git")) -> DataFrame:
    """title, path, text, updated_at of the notes (markdown files: path, content) outside excluded folders, as wikitext; empty notes are left out.

    A title is the first top heading of a note, else its file's name; of equal titles the first by path stays and the others carry their path. The time
    depends on the text alone, so a note is new when its text is.
    """
    inside = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded)))
    notes = documents.where(F.lower("path").endswith(".md") & ~inside)
    heading = F.regexp_extract("content", r"(?dm)^#[^\S\n]+(\S[^\n]*)$", 1)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    notes = notes.withColumn("title", F.when(heading != "", F.rtrim(heading, F.lit(fn.BLANKS))).otherwise(stem))
    notes = notes.select("title", "path", as_wikitext(F.col("content"), F.col("title")).alias("text")).where("text <> ''")
    again = F.row_number().over(Window.partitionBy("title").orderBy("path")) > 1
    title = F.when(again, F.concat("title", F.lit(" ("), "path", F.lit(")"))).otherwise(F.col("title"))
    seconds = F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("long") % 1_000_000_000
    return notes.select(title.alias("title"), "path", "text", F.timestamp_seconds(seconds).alias("updated_at"))


#: Marks a top heading until it is known whether it repeats the title.
_TOP = "\x01"


def as_wikitext(markdown: Column, title: Column) -> Column:
    """Markdown as wikitext. Lines between fences stay as they are and the fences go; elsewhere headings get bars, table rows become their cells between dashes, marks of
    quotes, lists and rules go, images go, links and emphasis leave their words. The first top heading that is the title is left out. Links between double brackets stay."""

    def spoken(x: Column) -> Column:
        """A text without what is not read out."""
        x = F.regexp_replace(F.regexp_replace(x, r"!\[[^\]\n]*\]\([^)\n]*\)", ""), r"(?<!\[)\[([^\[\]\n]+)\]\([^)\n]*\)", "$1")
        return F.regexp_replace(F.regexp_replace(x, r"(?<!\*)(\*{1,3})([^*\n]+)\1(?!\*)", "$2"), "`([^`\n]+)`", "$1")

    def line(x: Column) -> Column:
        level, said = F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)), fn.trimmed(F.regexp_replace(x, "^#+", ""))
        bars = F.repeat(F.lit("="), F.greatest(level, F.lit(2)))
        heading = F.concat(F.when(level == 1, _TOP).otherwise(""), bars, F.lit(" "), said, F.lit(" "), bars)
        cells = F.filter(F.transform(F.split(x, r"\|"), fn.trimmed), lambda c: c != "")
        return F.when((level > 0) & (said != ""), heading).when(x.rlike(r"^\s*\|"), F.array_join(cells, " - ")).otherwise(x)

    def open_part(x: Column) -> Column:
        """The lines between two fenced blocks."""
        x = fn.by_line(F.regexp_replace(x, r"(?dm)^[^\S\n]*\|[ \t|:-]*(?:\n|\z)", ""), line)  # without the line under a table's head
        for mark in (r"[^\S\n]*>[^\S\n]?", r"[^\S\n]*(?:[-*+]|\d+\.)[^\S\n]+", r"[^\S\n]*(?:-{3,}|\*{3,}|_{3,})[^\S\n]*$"):
            x = F.regexp_replace(x, f"(?dm)^{mark}", "")
        return spoken(x)

    parts = F.split(without_front(F.regexp_replace(markdown, _TOP, "")), r"(?dm)^[^\S\n]*(?:```|~~~)[^\n]*(?:\n|\z)")
    whole = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, open_part(x)).otherwise(x)), "")
    around = F.split(whole, F.concat(F.lit(f"(?dm)^{_TOP}== "), fn.quoted(title), F.lit(" ==$\n?")), 2)
    return fn.trimmed(F.regexp_replace(F.regexp_replace(F.array_join(around, ""), _TOP, ""), r"\n{3,}", "\n\n"))
