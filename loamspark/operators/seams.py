"""Where a user's own functions go in: similarities with their bands, embedders, extractors and selectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from . import candidates, matching, similarity


@dataclass(frozen=True)
class Similarity:
    """How alike two representations are, made from a name and aliases, and the band that this score is read with."""

    represent: Callable[[Column, Column], Column]
    score: Callable[[Column, Column], Column]
    band: tuple[float, float]


#: Trigrams of names and aliases.
LEXICAL = Similarity(lambda name, aliases: fn.grams(matching.name_text(name, aliases)), matching.set_overlap, matching.LEXICAL_BAND)
#: An embedder gives a vector column for a text column, in any way: built-in functions or a pandas UDF.
Embedder = Callable[[Column], Column]


def by_embedding(embed: Embedder, band: tuple[float, float] = matching.EMBEDDING_BAND) -> Similarity:
    """Cosines from 0 to 1 of an embedder's vectors."""
    clamped = lambda a, b: F.least(F.lit(1.0), F.greatest(F.lit(0.0), similarity.cosine(a, b)))
    return Similarity(lambda name, aliases: embed(matching.name_text(name, aliases)), clamped, band)


def matched(subjects: DataFrame, known: DataFrame, exact: DataFrame, by: Similarity = LEXICAL, limit: int = 20) -> DataFrame:
    """matching.decisions for subjects (subject, type, name, aliases) among known (candidate, type, name, aliases, nth): narrowed by words, scored by a similarity, read with its band."""
    words = lambda rows: rows.withColumn("words", matching.name_words(F.col("name"), F.col("aliases"))).withColumn("shape", by.represent(F.col("name"), F.col("aliases")))
    a, b = words(subjects), words(known)
    near = matching.narrowed(a.select("subject", "type", "words"), b.select("candidate", "type", "words", "nth"), limit)
    met = near.join(a.select("subject", F.col("shape").alias("_a")), "subject").join(b.select("candidate", F.col("shape").alias("_b")), "candidate")
    scored = met.select("subject", "candidate", "place", "overlap", by.score(F.col("_a"), F.col("_b")).alias("similarity"))
    return matching.decisions(subjects.select("subject"), scored, exact, by.band)


def embedded(rows: DataFrame, text: str, embed: Embedder, width: int, out: str = "vector") -> DataFrame:
    """rows with the vectors of their texts; a vector of another width is an error. Each distinct text is embedded once, so repeated rows cost nothing more."""
    texts = rows.select(text).where(F.col(text).isNotNull()).distinct().withColumn(out, embed(F.col(text)))
    checked = F.when(F.size(out) == width, F.col(out)).otherwise(F.raise_error(F.lit(f"vector of another width than {width}")).cast(texts.schema[out].dataType))
    return rows.join(texts.withColumn(out, checked), text, "left")


#: An extractor gives (summary, keywords) for a chunk's text.
Extractor = Callable[[Column], Column]


def extracted(chunks: DataFrame, text: str, extract: Extractor) -> DataFrame:
    """chunks with summary, questions and keywords."""
    found = chunks.withColumn("_x", extract(F.col(text)))
    question = F.array(F.concat(F.lit("What does "), "breadcrumb", F.lit(" say about this?")))
    return found.withColumn("summary", F.col("_x.summary")).withColumn("questions", question).withColumn("keywords", F.col("_x.keywords")).drop("_x")


def heuristic(text: Column, n: int = 8) -> Column:
    """(summary, keywords) without any model: the first sentence, and the most frequent words by falling count, ties by first place."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)")), lambda w: (F.length(w) > 3) & ~w.isin(fn.EXCERPT_STOP))

    def top(all_words: Column) -> Column:
        counted = F.transform(F.array_distinct(all_words), lambda w, i: F.struct((-F.size(F.filter(all_words, lambda x: x == w))).alias("n"), i.alias("at"), w.alias("w")))
        return F.transform(F.slice(F.array_sort(counted), 1, n), lambda x: x["w"])

    return F.struct(fn.section_summary(text).alias("summary"), F.get(F.transform(F.array(words), top), 0).alias("keywords"))


#: A selector gives case, slug and rank (from 1) for cases of edits.
Selector = Callable[[DataFrame], DataFrame]


def selection_quality(select: Selector, cases: DataFrame, expected: DataFrame, forbidden: DataFrame, cap: int = 10) -> DataFrame:
    """candidates.propagation of what a selector gives, averaged over all cases."""
    scores = candidates.propagation(expected, forbidden, select(cases), cap)
    return scores.agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in scores.columns if c != "case"])
