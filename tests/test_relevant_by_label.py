"""What is relevant to a query by its label is counted, not listed."""

import random

import duckdb
from pyspark.sql import functions as F

from loamspark.operators import retrieval
from loamspark.plans import registry


def join_rows(node):
    """The rows that each join of a plan that ran gave."""
    name = node.nodeName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
    children = inner or [node.children().apply(i) for i in range(node.children().size())]
    own = [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for c in children for n in join_rows(c)]


def test_relevant_pairs_are_not_made(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)], None if i % 60 == 40 else i % 200 // 190) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["lore_quality"](spark, str(tmp_path))
    rows = [tuple(r) for r in got.collect()]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows == con.execute(f"select {', '.join(got.columns)} from ({registry.SQL['lore_quality']})").fetchall() and rows[0][0] == 20
    made = join_rows(got._jdf.queryExecution().executedPlan())
    assert made and max(made) < 5000, made  # hits and groups that queries meet; pairs of one label are over 10,000


def test_judged_like_listed_pairs(spark):
    draw = random.Random(8)
    chunks = spark.createDataFrame([(i, draw.choice("abc")) for i in range(40)] + [(40, "alone")], "vec_id long, label string")
    asked = chunks.where("vec_id % 5 = 0")
    hits = spark.createDataFrame([(q, v, draw.random()) for q in range(0, 41, 5) for v in draw.sample(range(41), 9) if v != q], "query_id long, vec_id long, score double")
    gold = asked.select(F.col("vec_id").alias("query_id"), "label").join(chunks, "label").where("query_id <> vec_id").select("query_id", "vec_id")
    want = retrieval.quality(hits, gold, 4, 0.3)
    got = retrieval.judged(*retrieval.labelled(hits, asked, chunks), 4, 0.3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
