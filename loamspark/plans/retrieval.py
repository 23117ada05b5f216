"""Queries over vectors and token sets. In the embeddings a label is a universe and vectors of one label are one entity.

Every vec_id divisible by 20 is a query, against all others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import similarity as op
from ..sources import table

QUERIES, SQL = {}, {}
EACH_20TH = "vec_id % 20 = 0"


def nearest(spark, d, asked=EACH_20TH):
    vectors = table(spark, d, "embeddings")
    return op.nearest(vectors.where(asked), vectors, 10, -1.0, "label").select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


_DOT = "list_inner_product(q.embedding::double[], p.embedding::double[])"
_COSINE = f"{_DOT} / (sqrt(list_inner_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_inner_product(p.embedding::double[], p.embedding::double[])))"
QUERIES["nearest_vectors"] = nearest
SQL["nearest_vectors"] = f"""
select query_id, vec_id, rank, round(score, 5) as score from (select q.vec_id as query_id, p.vec_id, {_COSINE} as score, row_number() over (partition by q.vec_id order by {_COSINE} desc, p.vec_id) as rank
  from embeddings q join embeddings p on q.label = p.label and q.vec_id <> p.vec_id where q.vec_id % 20 = 0) where rank <= 10"""


def boosted(spark, d, asked=EACH_20TH):
    """Cosine plus 0.03 where a keyword (here the parity of the id) is shared, then the floor, then the top 12."""
    vectors = table(spark, d, "embeddings")
    return op.best(vectors.where(asked), vectors, 12, 0.2, [], lambda q, p: 0.03 * ((p - q) % 2 == 0), 0.03)


def boosted_rounded(spark, d, asked=EACH_20TH):
    return boosted(spark, d, asked).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


QUERIES["boosted_retrieval"] = boosted_rounded
SQL["boosted_retrieval"] = f"""
with s as (select q.vec_id as query_id, q.label as ql, p.label as pl, p.vec_id, {_COSINE} + case when (p.vec_id - q.vec_id) % 2 = 0 then 0.03::double else 0 end as score from embeddings q join embeddings p on q.vec_id <> p.vec_id where q.vec_id % 20 = 0)
select query_id, vec_id, round(score, 5) as score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= 0.2 qualify row_number() over (partition by query_id order by score desc, vec_id) <= 12"""


def quality(spark, d, asked=EACH_20TH):
    """Recall at 12 and reciprocal rank of each query; vectors of the same label are relevant."""
    vectors = table(spark, d, "embeddings")
    queries = vectors.where(asked).select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    sizes = vectors.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    hits = boosted(spark, d, asked).join(vectors.select("vec_id", "label"), "vec_id")
    found = queries.join(sizes, F.col("wanted") == F.col("label")).drop("label").join(hits, "query_id", "left")
    good = F.col("label") == F.col("wanted")
    out = found.groupBy("query_id", "relevant").agg(F.count_if(good).alias("hits"), F.coalesce(F.max(F.when(good, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return out.select("query_id", F.round(F.try_divide("hits", F.least("relevant", F.lit(12))), 6).alias("recall"), F.round("rr", 6).alias("reciprocal_rank"))


QUERIES["retrieval_quality"] = quality
SQL["retrieval_quality"] = f"""
with s as (select q.vec_id as query_id, q.label as ql, p.label as pl, p.vec_id, {_COSINE} + case when (p.vec_id - q.vec_id) % 2 = 0 then 0.03::double else 0 end as score from embeddings q join embeddings p on q.vec_id <> p.vec_id where q.vec_id % 20 = 0),
h as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= 0.2 qualify rank <= 12),
q as (select e.vec_id as query_id, e.label, (select count(*) - 1 from embeddings x where x.label = e.label) as relevant from embeddings e where e.vec_id % 20 = 0)
select q.query_id, round(count(*) filter (h.ql = h.pl) / nullif(least(relevant, 12), 0)::double, 6) as recall, round(coalesce(max(case when h.ql = h.pl then 1.0::double / rank end), 0), 6) as reciprocal_rank
from q left join h on h.query_id = q.query_id group by q.query_id, relevant"""


def sweep(spark, d, asked=EACH_20TH):
    vectors = table(spark, d, "embeddings")
    return op.cell_costs(op.pair_cells(vectors.where(asked), vectors))


QUERIES["threshold_sweep"] = sweep
SQL["threshold_sweep"] = f"""
with s as (select greatest(0, {_COSINE}) as score, q.label = p.label as same from embeddings q join embeddings p on q.vec_id <> p.vec_id where q.vec_id % 20 = 0), c as (select floor(score * 20 + 1e-9) as cell, same from s)
select i * 5 / 100.0::double as threshold, count(*) filter (not same and cell >= i) as false_merges, count(*) filter (same and cell < i) as false_splits, 5.0::double * count(*) filter (not same and cell >= i) + count(*) filter (same and cell < i) as cost
from range(1, 20) r(i), c group by i"""
QUERIES["benchmark_jaccard"] = lambda spark, d: op.jaccard_join(table(spark, d, "benchmark").select("item_id", fn.unicode_words(F.col("text")).alias("tokens")), "item_id", "tokens", 0.05).select("a", "b", F.round("jaccard", 6).alias("jaccard"))
SQL["benchmark_jaccard"] = """
with t as (select item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from benchmark),
p as (select x.item_id as a, y.item_id as b, len(list_intersect(x.w, y.w)) as n, len(x.w) + len(y.w) as m from t x join t y on x.item_id < y.item_id)
select a, b, round(n / (m - n)::double, 6) as jaccard from p where n > 0 and n / (m - n)::double >= 0.05"""
