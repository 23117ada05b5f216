"""Pairs of a large graph are made in blocks, where they are scored, and are not sent around."""

import random

from pyspark.sql import functions as F

from loamspark.operators import candidates, ways
from loamspark.plans import registry

FOLDER = "/root/testdata/sf0.001"


def above_pairs(frame):
    """What the plan has above the step that makes the pairs."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("FlatMapGroupsInArrow")]


def test_scores_like_all_evidence_summed(spark, monkeypatch):
    """Paths of several labels, nulls among labels and keys, rejections of nodes that are none, against sums over the rows of pool, in several blocks."""
    monkeypatch.setattr(ways, "ROWS", 100)
    monkeypatch.setattr(ways, "BLOCKS", 1)
    monkeypatch.setattr(ways, "PAIRS", 7)
    draw = random.Random(3)
    world = spark.createDataFrame([(f"e{i}", f"Name{i}", [f"the {i % 7}th"], f"Name{i * 3 % 50} met the {i % 5}th. Name{i}.") for i in range(50)], "entity string, name string, aliases array<string>, body string")
    some = lambda: f"e{draw.randrange(60)}"
    edges = spark.createDataFrame([(some(), some(), draw.choice(["owns", "near", "of", None]), n) for n in range(70)], "source string, target string, label string, nth long")
    similar = spark.createDataFrame([(f"e{draw.randrange(20)}", some(), draw.random(), "s") for _ in range(60)], "source string, entity string, similarity double, sentence string")
    reasons = ["wrong", "too much", "prose", "already true", None]
    history = spark.createDataFrame([(n, some(), draw.sample(["owns", "near", "of", "x"], draw.randrange(4)) + [None] * (n % 9 == 0), draw.choice(reasons)) for n in range(80)], "record int, target string, keys array<string>, reason string")
    edited = world.where("cast(substr(entity, 2) as int) < 20")
    fresh = edited.select(F.col("entity").alias("source"), F.lit(0).alias("at"), F.concat(F.lit("Saw the 3th and "), "name", F.lit(".")).alias("sentence"))
    pool = candidates.pool(edited, world, edges, fresh, similar)
    number = pool.groupBy("source", "entity").agg(F.count("*").alias("evidence"))
    wanted = candidates.penalties(candidates.base_scores(pool), history).join(number, ["source", "entity"])
    columns = ["source", "entity", F.round("score", 6), "evidence", F.round("penalty", 6), F.round("final", 6)]
    want = sorted(map(tuple, wanted.select(columns).collect()))
    got = candidates.scores(edited, world, edges, fresh, similar, history)
    assert sorted(map(tuple, got.select(columns).collect())) == want and len(want) > 300
    plain = candidates.scores(edited, world, edges, fresh, similar, columns=("evidence", "score"))
    assert sorted(map(tuple, plain.select("source", "entity", F.round("score", 6), "evidence").collect())) == [r[:4] for r in want]


def test_no_edges_and_no_mentions(spark):
    world = spark.createDataFrame([("a", "Ann", None, "Nothing here."), ("b", "Bob", None, "Ann.")], "entity string, name string, aliases array<string>, body string")
    edges = spark.createDataFrame([], "source string, target string, label string, nth long")
    fresh = spark.createDataFrame([], "source string, at int, sentence string")
    got = candidates.scores(world.where("entity = 'a'"), world, edges, fresh)
    assert [tuple(r) for r in got.collect()] == [("a", "b", 0.8, 1, 0.0, 0.8)]
    assert candidates.scores(world.where("entity = 'b'"), world, edges, fresh).count() == 0


def test_rejections_are_weighed_where_pairs_are_made(spark):
    assert "Exchange" not in above_pairs(registry.QUERIES["reject_penalties"](spark, FOLDER))


def test_candidates_are_summed_where_pairs_are_made(spark):
    assert "Exchange" not in above_pairs(registry.QUERIES["candidate_scores"](spark, FOLDER))


def test_ways_are_not_sent_around_by_start_and_node(spark):
    assert "Exchange" not in above_pairs(registry.QUERIES["graph_paths"](spark, FOLDER))
