"""Which texts contain which passages, by an equi join on word runs, and chunks of pages."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn

#: Words within a passage that a text must have in a row; characters, for passages without such words.
RUN, CHARS = 5, 4
#: So many keys of passages at most are part of a plan.
LISTED = 1000


def contained(texts: DataFrame, passages: DataFrame, text: str, passage: str) -> DataFrame:
    """texts x passages where the text holds the passage, character by character. Empty passages are in none.

    The words of a passage but the first and the last stand in the text as they are. So a passage and a text meet on the passage's first inner
    words (up to RUN), and are then verified; passages without inner words meet on their first characters. Up to LISTED keys are held against a text's own
    where it is read, and only what meets becomes a row; more keys meet all runs of all texts by a join.
    """
    inner = F.slice(F.col("_words"), F.lit(2), F.greatest(F.size("_words") - 2, F.lit(0)))
    rows = passages.where(F.length(passage) > 0).withColumn("_words", F.split(fn.trimmed(F.col(passage)), rf"{fn.BLANK}+")).withColumn("_run", F.slice(inner, 1, RUN))
    worded = rows.where(F.size("_run") > 0).withColumn("_k", F.size("_run")).withColumn("_key", F.xxhash64(F.array_join("_run", " "))).drop("_words", "_run")
    short = rows.where(F.size("_run") == 0).withColumn("_k", F.least(F.length(passage), F.lit(CHARS))).withColumn("_key", F.xxhash64(F.substring(F.col(passage), F.lit(1), F.col("_k")))).drop("_words", "_run")

    def sizes(df: DataFrame) -> list[int]:
        return sorted(r["_k"] for r in df.select("_k").distinct().collect())  # at most RUN numbers

    def word_runs(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("_w") - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice(F.col("_w"), i, k), " ")))

    def char_runs(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.xxhash64(F.substring(F.col(text), i, F.lit(k))))

    def met_keys(runs: Column, rows: DataFrame) -> Column:
        keys = [r["_key"] for r in rows.select("_key").distinct().limit(LISTED + 1).collect()]
        return F.array_intersect(runs, F.array(*map(F.lit, keys))) if len(keys) <= LISTED else F.array_distinct(runs)

    out = None
    for k in sizes(worded):
        split = texts.withColumn("_w", F.split(fn.trimmed(F.col(text)), rf"{fn.BLANK}+")).where(F.size("_w") >= k)
        keyed = split.withColumn("_key", F.explode(met_keys(word_runs(k), worded.where(F.col("_k") == k)))).drop("_w")
        found = keyed.join(worded.where(F.col("_k") == k), "_key").where(F.contains(F.col(text), F.col(passage))).drop("_key", "_k")
        out = found if out is None else out.unionByName(found)
    for k in sizes(short):
        keyed = texts.where(F.length(text) >= k).withColumn("_key", F.explode(met_keys(char_runs(k), short.where(F.col("_k") == k))))
        found = keyed.join(short.where(F.col("_k") == k), "_key").where(F.contains(F.col(text), F.col(passage))).drop("_key", "_k")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.join(passages, F.lit(False))


#: A heading of a page's text: as many bars, two to six, on both sides.
HEADING = r"^(={2,6})\s*(.+?)\s*\1\s*$"
LEVELS = range(2, 7)
#: What parts a text that is too long, from coarse to fine, and what joins its units again.
BREAKS = ((re.compile(r"\n{2,}"), "\n\n"), (re.compile(r"(?<=[.!?])\s+"), " "), (re.compile(r"\s+"), " "))


def sections(pages: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """key, page, section, breadcrumb, body: the parts of each page's text under its headings, those without text left out. page tells rows of equal keys apart.

    The way to a heading is, for every level above its own, the last heading of that level since one of a higher level; levels that were jumped over are empty.
    """
    rows = pages.select(key, F.monotonically_increasing_id().alias("page"), F.coalesce(title, F.lit("")).alias("title"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    lines = rows.select(key, "page", "title", F.posexplode("lines").alias("at", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    lines = lines.withColumn("level", level).withColumn("section", F.count_if(F.col("level") > 0).over(Window.partitionBy("page").orderBy("at")))
    parts = lines.groupBy(key, "page", "title", "section").agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("level") > 0, F.regexp_extract("line", HEADING, 2))).alias("heading"),
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("at", "line")))).alias("lines"),
    )
    crumbs = [F.col("title")]
    for n in LEVELS:
        since = F.count_if((F.col("level") > 0) & (F.col("level") < n)).over(Window.partitionBy("page").orderBy("section"))
        last = F.last(F.when(F.col("level") == n, F.col("heading")), ignorenulls=True).over(Window.partitionBy("page", f"_{n}").orderBy("section"))
        parts = parts.withColumn(f"_{n}", since).withColumn(f"way_{n}", last)
        crumbs.append(F.when(F.col("level") >= n, F.coalesce(f"way_{n}", F.lit(""))))
    body = fn.trimmed(F.array_join("lines.line", "\n"))
    return parts.select(key, "page", "section", F.concat_ws(" > ", *crumbs).alias("breadcrumb"), body.alias("body")).where("body <> ''")


def packed(text: str, tokens: int) -> list[str]:
    """Pieces of at most so many tokens, each four UTF-16 units: as many paragraphs as fit, in turn. A longer unit is parted at its sentences, a longer sentence at its blanks; a longer word stays whole."""
    limit, out, waiting = 4 * tokens, [], [(text, 0)]
    while waiting:
        text, depth = waiting.pop()
        if _units(text) <= limit or depth == len(BREAKS):
            out.append(text)
            continue
        pattern, joint = BREAKS[depth]
        parts = [p for p in pattern.split(text) if p.strip()]
        if len(parts) < 2:
            waiting.append((text, depth + 1))
            continue
        # where each part would end if all stood in a row, each with a joint behind it
        ends = list(accumulate((_units(p) + len(joint) for p in parts), initial=0))
        found, at = [], 0
        while at < len(parts):
            to = bisect_right(ends, ends[at] + limit + len(joint)) - 1
            found.append((joint.join(parts[at:to]), len(BREAKS)) if to > at else (parts[at], depth + 1))
            at = max(to, at + 1)
        waiting += reversed(found)
    return out


def _units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


def chunked(pages: DataFrame, key: str, title: str, text: str, tokens: int = 400) -> DataFrame:
    """key, index, breadcrumb, text: the chunks of each page's plain text, section by section."""

    def pieces(bodies: pd.Series) -> pd.Series:
        return pd.Series([[p for p in map(str.strip, packed(body, tokens)) if p] for body in bodies])

    parts = sections(pages, key, title, text)
    found = parts.select(key, "page", "section", "breadcrumb", F.posexplode(F.pandas_udf(pieces, "array<string>")("body")).alias("piece", "text"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("section", "piece")) - 1
    return found.select(key, place.alias("index"), "breadcrumb", "text")
