"""Literal rows with nulls, ties and empty tables."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from loamspark.functions import keys
from loamspark.functions import text as fn
from loamspark.operators import activity, browse, changes, graph, history, ledger, similarity
from loamspark.streaming import debounce


def test_first_outcome_keeps_null(spark):
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(1, "u", "s", at(0)), (2, "u", "a", at(5)), (3, "u", "s", at(9)), (4, "v", "a", at(1))], "id int, u string, k string, ts timestamp")
    got = activity.first_outcome(events, "u", "ts", "id", F.col("k") == "s", F.col("k") == "a").select("start_id", "seconds").collect()
    assert sorted(map(tuple, got)) == [(1, 5), (3, None)]


def test_rates_of_nothing_are_null(spark):
    rows = spark.createDataFrame([("a", "x")], "g string, k string")
    assert activity.accept_rates(rows, [F.col("g")], F.col("k") == "y", F.col("k") == "n").first()["accept_rate"] is None


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(r["v"] for r in changes.upsert(old, new, "k").collect()) == ["a", "c", "d", "n"]
    assert sorted(r["v"] for r in changes.insert_absent(old, new, "k").collect()) == ["a", "b", "d", "n"]
    assert sorted(map(tuple, changes.mark_missing(old, new, "k").collect())) == [(1, "a", True), (2, "b", False)]
    assert sorted(map(tuple, changes.mark_missing(old, new.limit(0), "k").select("k", "missing").collect())) == [(1, True), (2, True)]


def test_ledger(spark):
    rows = spark.createDataFrame([("k", 1), ("k", 2), (None, 3), (None, 4)], "key string, i int")
    assert sorted(r["i"] for r in ledger.idempotent(rows, ["key"], ["i"]).collect()) == [1, 3, 4]
    first, second = spark.range(1).select(*ledger.two_pools(F.lit(-3.0), F.lit(5.0))).first()
    assert (first, second) == (0.0, 5.0)


def test_ring_takes_the_nearest_depth(spark):
    """Of equally near ways the least relation; labels read from the node that the way comes from."""
    edges = [("4", "a", "b", "x", "-x"), ("9", "b", "c", "y", "-y"), ("5", "c", "a", "z", "-z"), ("6", "a", "c", "w", "-w"), ("3", "d", "c", "v", "-v"), ("2", "b", "d", "u", "-u"), ("1", "d", "e", "t", "-t")]
    edges = spark.createDataFrame(edges, "relation string, source string, target string, label string, inverse string")
    got = graph.ring(edges, spark.createDataFrame([("a",), ("a",)], "node string"), 2)
    assert got.columns == ["node", "depth", "relation", "via", "label"]
    assert sorted(map(tuple, got.collect())) == [("b", 1, "4", "a", "x"), ("c", 1, "5", "a", "-z"), ("d", 2, "2", "b", "u")]


def test_pages_beyond_the_ends(spark):
    rows = spark.range(7).select(F.col("id").cast("int").alias("i"))
    of = lambda n: [tuple(r) for r in browse.page(rows, [F.asc("i")], n, 3).collect()]
    assert of(99) == of(3) == [(6, 7)] and of(0) == of(-4) == of(1) == [(0, 7), (1, 7), (2, 7)]
    assert browse.page(rows.limit(0), [F.asc("i")], 5, 3).collect() == []


def test_edges_touch_both_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("d", "d")], "source string, target string")
    assert sorted(map(tuple, graph.touching(edges).collect())) == [("a", 3), ("b", 2), ("c", 1), ("d", 1)]


def test_similarity(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c", "c"]), (3, []), (4, ["z"])], "id int, t array<string>")
    assert [tuple(r) for r in similarity.jaccard_join(rows, "id", "t", 0.8).collect()] == [(1, 2, 1.0)]
    zero = F.array(F.lit(0.0))
    assert spark.range(1).select(similarity.cosine(zero, zero)).first()[0] == 0.0


def test_best_overlaps_by_brute_force(spark, monkeypatch):
    """Sets of owners by groups, ties, empty sets, questions that share nothing; with few and with many sets in the first look."""
    rng = random.Random(6)
    some = lambda n: sorted({rng.choice("abcdefghijklmnop"[: rng.choice([4, 16])]) for _ in range(rng.randint(0, n))})
    sets = [(rng.choice("uv"), i, i // 2, 1 + i % 2, some(7)) for i in range(120)]
    asked = [(rng.choice("uvw"), i, some(9)) for i in range(25)]
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    frames = spark.createDataFrame(sets, "type string, set int, owner int, weight int, tokens array<string>"), spark.createDataFrame(asked, "type string, question int, tokens array<string>")
    for seeds in (1, 5, 1000):
        monkeypatch.setattr(similarity, "SEEDS", seeds)
        got = similarity.best_overlaps(*frames, 4, ["type"]).collect()
        for t, q, wanted in asked:
            mine = {r["set"]: r["score"] for r in got if r["question"] == q}
            scores = {i: jaccard(wanted, w) for u, i, _, _, w in sets if u == t and jaccard(wanted, w) > 0}
            assert mine.items() <= scores.items()
            best = {}  # of each owner, its best score and its largest weight
            for _, i, owner, weight, _ in sets:
                if i in scores:
                    best[owner] = tuple(map(max, best.get(owner, (0, 0)), (scores[i], weight)))
            placed, last = 0, 0.0  # the score at which the limit is reached
            for score, weight in sorted(best.values(), reverse=True):
                placed += weight
                if placed >= 4:
                    last = score
                    break
            assert {i for i, s in scores.items() if s >= last} <= mine.keys()


def test_texts(spark):
    row = spark.range(1).select(
        fn.slug(F.lit("Éa  b!")).alias("slug"),
        fn.slug(F.lit(None).cast("string")).alias("none"),
        fn.without_fences(F.lit("a\n:::secret\nx\n:::\nb")).alias("fence"),
        fn.without_fences(F.lit("a\n:::gmnote\nx")).alias("open"),
        fn.wikilinks(F.lit("[[A]] and [[B|c]]")).alias("links"),
    )
    assert row.first().asDict() == {"slug": "ea-b", "none": "entry", "fence": "a\nb", "open": "a\n", "links": ["A", "B"]}


def test_debounce_as_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1, 0, s // 60, s % 60)
    rows = [(1, "k", at(0), "a"), (1, "k", at(0), "a"), (2, "k", at(30), "b"), (3, "k", at(200), "c"), (4, "z", at(3000), "end")]
    spark.createDataFrame(rows, "id int, k string, ts timestamp, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, k string, ts timestamp, v string").parquet(str(tmp_path / "in"))
    out = debounce.debounced(debounce.once(stream, "id", "ts"), "k", "ts", "v", late=None)
    query = out.writeStream.format("memory").queryName("bursts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["n"], r["first_value"], r["last_value"]) for r in spark.table("bursts").collect())
    assert got == [(1, "c", "c"), (2, "a", "b")]


def test_sessions_include_their_bounds(spark):
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    rows = [(1, "u", "v", at(1)), (2, "u", "s", at(2)), (3, "u", "v", at(2)), (4, "u", "e", at(5)), (5, "u", "v", at(5)), (6, "u", "v", at(6)), (7, "w", "s", at(1)), (8, "w", "v", at(9)), (9, None, "v", at(1))]
    events = spark.createDataFrame(rows, "id int, u string, k string, ts timestamp")
    starts, ends = F.col("k") == "s", F.col("k") == "e"
    out = history.in_no_session(events, "u", "ts", starts, ends, F.lit(at(8)), F.col("k") == "v").collect()
    assert sorted(r["id"] for r in out) == [1, 6, 8, 9]
    closed = history.sessions(events, "u", "ts", starts, ends)
    assert [r["id"] for r in history.after_session(events.where("k = 'v'"), closed, "u", "ts", 168).collect()] == [6]


def test_histories(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 5, "y"), ("a", 3, 6, "y"), (None, 1, None, None)], "k string, o int, p int, v string")
    assert sorted((r["o"], r["stale"]) for r in history.stale(rows.where("k = 'a'"), "k", "o", "p").collect()) == [(1, False), (2, True), (3, False)]
    assert [r["o"] for r in history.settled(rows, "k", "o", "p", F.col("v") == "y").collect()] == [2]
    assert {r["k"]: r["next_position"] for r in history.next_position(rows, "k", "p").collect()} == {"a": 7, None: 0}
    assert {r["key"]: (r["members"], r["times"]) for r in history.folded(rows, F.col("k"), "v").collect()} == {"a": (["x", "y"], 3), None: ([], 1)}
    assert [r["admitted"] for r in history.admitted(rows.where("k = 'a'"), rows.limit(0), "k", "o", 2).orderBy("o").collect()] == [True, True, False]
    assert history.stale(rows.limit(0), "k", "o", "p").count() == 0


def test_keys(spark):
    import hashlib
    import uuid

    row = spark.range(1).select(keys.name_uuid(F.lit("ä"), F.lit("1")).alias("u"), keys.name_uuid(F.lit("a"), F.lit(None)).alias("n"), keys.fingerprint(F.array(F.lit("b"), F.lit(None), F.lit("a")), "v").alias("f")).first()
    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "ä\0001")) and row["n"] is None
    assert row["f"] == hashlib.sha256("\1a\1b\1v".encode()).hexdigest()


def test_top_words_break_ties_by_place(spark):
    docs = spark.createDataFrame([(1, "zeta beta beta that zeta cat gamma"), (2, None), (3, "")], "id int, text string")
    assert [(r["id"], r["keywords"]) for r in fn.top_words(docs, "id", "text", 2).collect()] == [(1, "zeta beta")]


def test_fingerprints_of_nulls(spark):
    """A null id counts as an empty one, ids are sorted, versions follow."""
    ids = F.array(F.lit("b"), F.lit(None).cast("string"), F.lit("a"))
    got = spark.range(1).select(keys.fingerprint(ids, "v1", "m").alias("some"), keys.fingerprint(F.array().cast("array<string>"), "v1").alias("none")).first()
    assert got["some"] == hashlib.sha256("\x01".join(["", "a", "b", "v1", "m"]).encode()).hexdigest()
    assert got["none"] == hashlib.sha256(b"v1").hexdigest()
