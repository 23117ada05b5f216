"""Users' own functions, and feeds as tables and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamspark.operators import matching, seams, writes
from loamspark.streaming import feeds


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def at(s):
    return dt.datetime(2026, 1, 1, 0, 0, s)


def test_similarities_come_with_their_bands(spark):
    subjects = spark.createDataFrame([(1, "p", "Gilded Rat", []), (2, "p", "Nowhere", [])], "subject int, type string, name string, aliases array<string>")
    known = spark.createDataFrame([(10, "p", "The Gilded Rat", [], 0), (11, "p", "Gilded Rat", ["inn"], 1), (12, "q", "Gilded Rat", [], 2)], "candidate int, type string, name string, aliases array<string>, nth int")
    none = spark.createDataFrame([], "subject int, candidate int")
    assert rows(seams.matched(subjects, known, none).select("subject", "outcome", "candidates"), "subject") == [(1, "ask", [11, 10]), (2, "new", None)]
    hashed = seams.by_embedding(lambda t: matching.word_vector(t, 64))
    assert rows(seams.matched(subjects, known, none, hashed).select("subject", "outcome", "candidates"), "subject")[0] == (1, "match", [10])


def test_embedders_are_checked(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, text string")
    got = rows(seams.embedded(docs, "text", lambda t: matching.word_vector(t, 8), 8).select("id", F.size("vector")), "id")
    assert got[:2] == [(1, 8), (2, 8)] and got[2][1] in (-1, None)
    with pytest.raises(Exception, match="another width"):
        seams.embedded(docs, "text", lambda t: matching.word_vector(t, 8), 9).collect()


def test_heuristic_extraction(spark):
    chunks = spark.createDataFrame([("P > A", "Zeta beta beta. Then zeta from gamma with omega!"), ("P", "")], "breadcrumb string, text string")
    got = rows(seams.extracted(chunks, "text", lambda t: seams.heuristic(t, 3)).select("summary", "questions", "keywords"), F.desc("breadcrumb"))
    assert got == [("Zeta beta beta.", ["What does P > A say about this?"], ["zeta", "beta", "then"]), ("", ["What does P say about this?"], [])]


def test_selectors(spark):
    cases = spark.createDataFrame([("c",), ("d",)], "case string")
    expected = spark.createDataFrame([("c", "x"), ("c", "y")], "case string, slug string")
    forbidden = spark.createDataFrame([("c", "z"), ("d", "z")], "case string, slug string")
    got = seams.selection_quality(lambda c: c.select("case", F.lit("x").alias("slug"), F.lit(1).alias("rank")), cases, expected, forbidden)
    assert rows(got) == [(2, 0.75, 0.75, 0.0, 0.75)]


def test_replay(spark):
    events = spark.createDataFrame([("u", i) for i in range(10)] + [("v", 5)], "universe string, id int")
    since = spark.createDataFrame([("r", "u", 7), ("s", "u", None), ("t", "u", 1), ("w", "v", 5)], "reader string, universe string, since_id int")
    assert rows(feeds.replayed(events, "universe", "id", since, 4).select("reader", "id")) == [("r", 8), ("r", 9), *[("s", i) for i in (6, 7, 8, 9)], *[("t", i) for i in (6, 7, 8, 9)]]


GRANTS = [("a", "1", 0, 1, 10.0), ("a", "2", 1, 3, 10.0), ("a", "1", 2, 9, 10.0), ("a", "3", 3, 2, 10.0), ("a", "4", 4, 4, 5.0), ("b", "5", 0, 1, 1.0)]


def test_late_grants_as_table_and_stream(spark, tmp_path):
    schema = "account string, event_id string, ts timestamp, period long, amount double"
    log = spark.createDataFrame([(a, e, at(s), p, x) for a, e, s, p, x in GRANTS], schema)
    want = [("1", 10.0), ("2", 10.0), ("3", 0.0), ("4", 5.0), ("5", 1.0)]
    assert rows(feeds.grants(log).select("event_id", "granted"), "event_id") == want
    log.where("ts < '2026-01-01 00:00:03'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = feeds.grants(stream).writeStream.format("memory").queryName("grants").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        log.where("ts >= '2026-01-01 00:00:03'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.table("grants").select("event_id", "granted"), "event_id") == want


def test_indexing_in_batches(spark):
    held = {"points": spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "url string, page_updated_at int, chunk string")}

    def store(df):
        held["points"] = spark.createDataFrame(df.collect(), df.schema)

    index = feeds.indexer(lambda: held["points"], store, lambda pages: pages.withColumn("chunk", F.lit("new")))
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "url string, page_updated_at int")
    for _ in range(2):
        index(batch, 0)
        assert rows(held["points"], "url") == [("a", 1, "old"), ("b", 2, "new"), ("c", 1, "new")]


def test_keyed_paths(spark):
    types = spark.createDataFrame([("x", "k1", None, 0), ("x", "k2", "u", 1), ("y", "k3", None, 2)], "label string, key string, owner string, nth int")
    paths = spark.createDataFrame([(1, '["x","y","z","x"]'), (2, "[]"), (3, "{"), (4, None)], "id int, path string")
    assert rows(writes.keyed(paths, "id", "path", types), "id") == [(1, '["k2","k3","z","k2"]'), (2, "[]"), (3, "{"), (4, None)]
