"""Retrieval as it is used: over-fetching, exclusions, the keyword boost, thresholds, caches, and what it is worth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions import text as fn

#: What each keyword that a query has adds to a hit's score.
BOOST = 0.03
#: Patterns up to this many are broadcast (some hundred bytes each); beyond, only those of the same first characters meet a url.
BROADCAST_PATTERNS = 10_000
#: Characters before its first * by which a pattern and a url meet.
LEAD = 12


def keyword_count(query: Column, keywords: Column) -> Column:
    """How many of the keywords are words of the query; a keyword that is listed twice counts twice."""
    terms = fn.unicode_words(query)
    return F.size(F.filter(keywords, lambda k: F.array_contains(terms, F.lower(k))))


def not_excluded(hits: DataFrame, url: str, patterns: DataFrame, pattern: str = "pattern", keys: tuple[str, ...] = ()) -> DataFrame:
    """hits whose url matches no pattern (of the same keys). Patterns without * are joined by equality; the others by their first characters, and then verified."""
    low = patterns.select(*keys, F.lower(pattern).alias("_p")).where("_p is not null").distinct()
    rows = hits.withColumn("_u", F.lower(url))
    exact = low.where(~F.col("_p").contains("*")).withColumnRenamed("_p", "_u")
    rows = rows.join(exact, [*keys, "_u"], "left_anti")
    globs = low.where(F.col("_p").contains("*")).withColumn("_lead", F.substring(F.substring_index("_p", "*", 1), 1, LEAD)).withColumn("_size", F.length("_lead")).withColumn("_rx", predicates.glob_pattern(F.col("_p")))
    matches = F.call_function("rlike", F.col("_u"), F.col("_rx"))
    urls = rows.select(*keys, "_u").distinct()
    if globs.count() <= BROADCAST_PATTERNS:
        g = F.broadcast(globs.select(*[F.col(k).alias(f"_{k}") for k in keys], "_lead", "_rx"))
        on = F.col("_u").startswith(F.col("_lead")) & matches
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{k}"))
        hit = urls.join(g, on, "left_semi")
    else:
        sizes = urls.withColumn("_size", F.explode(F.sequence(F.lit(0), F.lit(LEAD)))).withColumn("_lead", F.substring(F.col("_u"), F.lit(1), F.col("_size")))
        hit = sizes.join(globs, [*keys, "_size", "_lead"]).where(matches).select(*keys, "_u").distinct()
    return rows.join(hit, [*keys, "_u"], "left_anti").drop("_u")


def boosted(hits: DataFrame, terms: Column, keywords: Column, per_match: float = BOOST) -> DataFrame:
    return hits.withColumn("score", F.col("score") + F.size(F.filter(keywords, lambda k: F.array_contains(terms, F.lower(k)))) * per_match)


def cut(hits: DataFrame, top_k: int, threshold: float, by: str = "query_id", tie: str = "vec_id") -> DataFrame:
    """hits at or above the threshold, the top_k best of each query, with rank."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie))
    return hits.where(F.col("score") >= threshold).withColumn("rank", place).where(F.col("rank") <= top_k)


def quality(hits: DataFrame, gold: DataFrame, top_k: int, threshold: float, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """query_id, reciprocal_rank, recall_at_<k>, survivors, irrelevant of each query of gold.

    hits has query_id, vec_id, score; gold has query_id, vec_id of what is relevant (null for a query without any, whose recall is 1). Recall is
    counted over what passes the threshold, also beyond top_k; the reciprocal rank and the irrelevant within top_k.
    """
    relevant = gold.where("vec_id is not null").select("query_id", "vec_id", F.lit(True).alias("good")).distinct()
    sizes = gold.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n"))
    passed = hits.where(F.col("score") >= threshold).select("query_id", "vec_id", "score")
    return judged(passed.join(relevant, ["query_id", "vec_id"], "left").fillna({"good": False}), sizes, top_k, threshold, ks)


def judged(hits: DataFrame, sizes: DataFrame, top_k: int, threshold: float, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``quality`` of hits (query_id, vec_id, score) that say whether they are good (null: neither that nor irrelevant); sizes has query_id and n, how many good ones there are. What is relevant need not be listed."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = hits.where(F.col("score") >= threshold).withColumn("rank", place)
    good = F.col("good")
    sums = found.groupBy("query_id").agg(
        F.max(F.when(good & (F.col("rank") <= top_k), 1 / F.col("rank"))).alias("rr"),
        *[F.count_if(good & (F.col("rank") <= k)).alias(f"at_{k}") for k in (*ks, top_k)],
        F.count("*").alias("survivors"),
        F.count_if(~good & (F.col("rank") <= top_k)).alias("irrelevant"),
    )
    out = sizes.join(sums, "query_id", "left")
    recall = lambda k: F.when(F.col("n") == 0, 1.0).otherwise(F.coalesce(f"at_{k}", F.lit(0)) / F.col("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("query_id", F.round(zero("rr"), 6).alias("reciprocal_rank"), *[F.round(recall(k), 6).alias(f"recall_at_{k}") for k in (*ks, top_k)], zero("survivors").alias("survivors"), zero("irrelevant").alias("irrelevant"))


def labelled(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hits with good (the query's label; null for a hit without one), and query_id, n: how many others have that label. Both tables have vec_id and label; queries without any are left out.

    Labels are counted and looked up for the hits alone: pairs of a query and all that has its label are as many as a share of all pairs.
    """
    of = chunks.groupBy("vec_id").agg(F.collect_set("label").alias("_of"))
    asked = questions.groupBy(F.col("vec_id").alias("query_id")).agg(F.collect_set("label").alias("_asked"))
    good = hits.join(asked, "query_id").join(of, "vec_id").withColumn("good", F.when(F.size("_of") > 0, F.arrays_overlap("_asked", "_of"))).drop("_asked", "_of")
    every = chunks.where("vec_id is not null").groupBy("label").agg(F.count("*").alias("_every"))
    own = chunks.groupBy("label", "vec_id").agg(F.count("*").alias("_own"))
    sizes = questions.select("vec_id", "label").join(every, "label").join(own, ["label", "vec_id"], "left")
    return good, sizes.groupBy(F.col("vec_id").alias("query_id")).agg(F.sum(F.col("_every") - F.coalesce("_own", F.lit(0))).alias("n")).where("n > 0")


def means(scores: DataFrame) -> DataFrame:
    """The means of quality's columns over all queries."""
    return scores.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in scores.columns if c != "query_id"])


#: What a retriever is to the evaluation: (questions, chunks) -> hits with query_id, vec_id and score.
Retriever = Callable[[DataFrame, DataFrame], DataFrame]


def evaluated(retrieve: Retriever, questions: DataFrame, chunks: DataFrame, gold: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """The means of quality of what a retriever finds."""
    return means(quality(retrieve(questions, chunks), gold, top_k, threshold))
