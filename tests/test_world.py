"""Graphs, candidates, diffs, matching, writes and sources on literal rows."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loamspark.functions import text as fn
from loamspark.operators import browse, candidates, diffs, graph, matching, mentions, retrieval, tallies, writes
from loamspark.sources import archives, connectors, vectors


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


ENTITIES = [
    ("rat", "The Gilded Rat", ["the tavern"], "Mara owns the tavern. [[Old Keep]] stands near."),
    ("mara", "Mara", [], "Mara drinks. She left Gilded Rats behind."),
    ("keep", "Old Keep", ["C++ (keep)"], "# Mara\n\nNothing. C++ (keep) is old."),
    ("zh", "龍", ["é"], "Only 龍王 here, and é."),
]


@pytest.fixture(scope="module")
def world(spark):
    return spark.createDataFrame(ENTITIES, "entity string, name string, aliases array<string>, body string")


def test_mentions(spark, world):
    names = mentions.names_of(world, "entity", "name", "aliases")
    got = rows(mentions.mentions(mentions.sentence_rows(world, "entity", "body"), names, ["source", "at"]).select("source", "at", "entity", "matched"), "source", "at", "entity")
    assert got == [
        ("keep", 0, "mara", "Mara"), ("keep", 2, "keep", "C++ (keep)"), ("mara", 0, "mara", "Mara"), ("rat", 0, "mara", "Mara"), ("rat", 0, "rat", "the tavern"), ("rat", 1, "keep", "Old Keep"), ("zh", 0, "zh", "龍"),
    ]


def test_mentions_like_a_plain_search(spark):
    """Against every name on every sentence, over short names and texts of few letters."""
    import re

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab_é龍 -") for _ in range(rng.randint(1, 4)))
    names = [(i, 0, word()) for i in range(60)]
    said = [(i, 0, "".join(word() for _ in range(rng.randint(1, 5)))) for i in range(120)]
    got = {(r["source"], r["entity"]) for r in mentions.mentions(spark.createDataFrame(said, "source int, at int, sentence string"), spark.createDataFrame([n for n in names if n[2].strip()], "entity int, nth int, name string"), ["source", "at"]).collect()}
    want = {(s, e) for s, _, x in said for e, _, n in names if n.strip() and re.search(rf"(?:^|[^A-Za-z0-9_]){re.escape(n)}(?:$|[^A-Za-z0-9_])", x, re.I)}
    assert got == want and len(want) > 50


def test_resolution(spark, world):
    links = spark.createDataFrame([(1, " the GILDED rat "), (2, "É"), (3, "nobody"), (4, ""), (5, None)], "i int, link string")
    assert rows(mentions.resolved(links, "link", world, "entity", "name", "aliases", "entity").select("i", "entity"), "i") == [(1, "rat"), (2, "zh"), (3, None), (4, None), (5, None)]


def test_paths_take_the_first_edges(spark):
    edges = spark.createDataFrame([("a", "b", "x", 2), ("a", "c", "y", 1), ("c", "d", "z", 4), ("b", "d", "w", 3), ("d", "e", "v", 5)], "source string, target string, label string, nth long")
    got = candidates.paths(edges, spark.createDataFrame([("a",), ("q",)], "node string"), 2)
    assert rows(got.select("node", "hops", F.array_join("path", ">")), "node") == [("b", 1, "x"), ("c", 1, "y"), ("d", 2, "y>z")]


def test_pool_and_penalties(spark, world):
    edited = world.where("entity = 'mara'")
    edges = spark.createDataFrame([("mara", "rat", "owns", 0), ("rat", "keep", "near", 1)], "source string, target string, label string, nth long")
    fresh = spark.createDataFrame([("mara", 0, "Now in Old Keep and the tavern, Mara!")], "source string, at int, sentence string")
    similar = spark.createDataFrame([("mara", "zh", 0.5, "s"), ("mara", "mara", 0.9, "s"), ("mara", "gone", 0.9, "s")], "source string, entity string, similarity double, sentence string")
    scores = candidates.base_scores(candidates.pool(edited, world, edges, fresh, similar))
    assert rows(scores.select("entity", "score", F.array_join("path", ">")), "entity") == [("keep", 2.3, "owns>near"), ("rat", 2.8, "owns"), ("zh", 0.3, "")]
    history = spark.createDataFrame([(1, "rat", ["x"], "wrong"), (2, "other", ["owns", "near"], "too much"), (3, "zh", [], "prose"), (4, "keep", ["owns"], None)], "record int, target string, keys array<string>, reason string")
    got = candidates.penalties(scores, history)
    assert rows(got.select("entity", "penalty", "final"), "entity") == [("keep", -0.2, 2.1), ("rat", -1.2, 1.6), ("zh", 0.0, 0.3)]


def test_audit_pairs(spark, world):
    edited = spark.createDataFrame([("mara", "She owns an old keep. The rest is mist.\n:::secret\nHidden.\n:::\nEnd.")], "entity string, body string")
    fresh = spark.createDataFrame([("mara", 0, "She saw Old Keep."), ("mara", 1, "Old Keep again and the tavern.")], "source string, at int, sentence string")
    got = candidates.audit_pairs(edited, world, fresh)
    assert rows(got.select("entity", "mine", "theirs", "rank"), "rank") == [
        ("keep", "She saw Old Keep.", "C++ (keep) is old.", 1), ("rat", "Old Keep again and the tavern.", "Mara owns the tavern.", 2),
    ]
    assert candidates.audit_pairs(edited, world, fresh, 1).count() == 1 and candidates.audit_pairs(edited, world, fresh.limit(0)).count() == 2


def test_own_canon(spark, world):
    asked = spark.createDataFrame([("q", "Who owns the tavern?"), ("none", "of the and")], "question string, text string")
    got = rows(candidates.own_canon(world, asked, "en").select("question", "entity", "statement", F.round("score", 4), "rank"))
    assert got == [("q", "rat", "Mara owns the tavern.", 0.6667, 1)]


def test_carried(spark):
    fresh = spark.createDataFrame([("g", "a", 1), ("g", "b", 2)], "g string, k string, o int")
    prior = spark.createDataFrame([("g", k, i) for i, k in enumerate("bcdcef")] + [("h", "z", 0)], "g string, k string, o int")
    assert rows(candidates.carried(fresh, prior, "k", "o", "g").select("g", "k", "position"), "g", "position") == [("g", "a", 1), ("g", "b", 2), ("g", "c", 3), ("g", "d", 4), ("g", "e", 5), ("h", "z", 1)]


def plain_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("kept", j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            out.append(("removed", i))
            i += 1
        else:
            out.append(("added", j))
            j += 1
    return out + [("removed", k) for k in range(i, len(a))] + [("added", k) for k in range(j, len(b))]


def test_alignment_by_the_whole_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert diffs.alignment(a, b) == plain_table(a, b)


def test_semantic_diff(spark):
    edits = spark.createDataFrame([(1, "The rat is old. Mara sings. Gone now.", "Mara sings. The rat is very old. New here."), (2, None, "One."), (3, "", ""), (4, "A b c d.", "A b c e. A b c f.")], "id int, old string, new string")
    got = rows(diffs.fact_rows(edits, ["id"], "old", "new").select("id", "kind", "statement", "previous"), "id", "at")
    assert got == [
        (1, "changed", "The rat is very old.", "The rat is old."), (1, "added", "New here.", None), (1, "removed", "Gone now.", None), (2, "added", "One.", None), (4, "changed", "A b c e.", "A b c d."), (4, "added", "A b c f.", None),
    ]


def test_prose_diff(spark):
    old = "# One\n\nA. B. C. D. E.\n\n# Two\n\nThe cat sat down."
    new = "# One\n\nA. B. C. D. E. F.\n\n# Two\n\nThe dog sat down."
    df = diffs.prose_diff(spark.createDataFrame([(1, old, new), (2, old, old)], "id int, o string, n string"), ["id"], "o", "n")
    got = df.orderBy("id", "at").collect()
    assert [(r["kind"], r["text"], r["units"]) for r in got] == [("kept", "One", None), ("gap", None, 4), ("kept", "E.", None), ("added", "F.", None), ("kept", "Two", None), ("changed", "The dog sat down.", None)]
    assert [tuple(s) for s in got[-1]["spans"]] == [("kept", "The"), ("removed", "cat"), ("added", "dog"), ("kept", "sat down.")]
    assert [tuple(r) for r in diffs.regions(df, ["id"]).collect()] == [(1, 2)]
    assert diffs.word_spans("a b c", "x y z") == [("removed", "a b c"), ("added", "x y z")]


def test_changed_sentences(spark):
    bodies = spark.createDataFrame([("e", "Old one. Keep.")], "entity string, body string")
    proposals = spark.createDataFrame([("e", 2, "Old one. Keep. New."), ("e", 1, "Keep. New."), ("f", 3, "x")], "entity string, proposal int, body string").withColumn("n", F.col("proposal"))
    assert rows(diffs.changed_sentences(proposals, bodies, "entity", "n")) == [("e", "New.", 1)]


def test_narrowing_by_brute_force(spark):
    rng = random.Random(3)
    words = lambda: sorted(set(rng.choices("abcdefgh", k=rng.randint(0, 3))))
    subjects, known = [(i, rng.choice("tu"), words()) for i in range(25)], [(i, rng.choice("ttu"), words(), i) for i in range(90)]
    got = matching.narrowed(spark.createDataFrame(subjects, "subject int, type string, words array<string>"), spark.createDataFrame(known, "candidate int, type string, words array<string>, nth int"), 7)
    overlap = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    want = []
    for s, t, w in subjects:
        best = sorted((-overlap(w, x), n, c) for c, u, x, n in known if u == t)[:7]
        want += [(s, c, i + 1) for i, (_, _, c) in enumerate(best)]
    assert rows(got.select("subject", "candidate", "place"), "subject", "place") == want


def test_decisions(spark):
    scored = spark.createDataFrame([(1, 10, 0.9, 0.1, 1), (1, 11, 0.9, 0.5, 2), (2, 10, 0.6, 0.0, 1), (2, 12, 0.7, 0.0, 2), (2, 13, 0.4, 0.0, 3), (3, 10, 0.2, 0.0, 1)], "subject int, candidate int, similarity double, overlap double, place int")
    subjects = spark.createDataFrame([(i,) for i in range(1, 6)], "subject int")
    got = matching.decisions(subjects, scored, spark.createDataFrame([(3, 99)], "subject int, candidate int"))
    assert rows(got, "subject") == [(1, "match", [11], 0.9), (2, "ask", [12, 10], 0.7), (3, "exact", [99], None), (4, "new", None, None), (5, "new", None, None)]


def test_relation_types(spark):
    types = spark.createDataFrame(
        [("a", None, "Leads", "led by", ["c"], ["f"], 0), ("b", "u", "leads", "commanded by", ["c"], ["p"], 1), ("s", None, "rival", "rival", ["c"], ["c"], 2)],
        "type string, owner string, label string, inverse string, allowed_from array<string>, allowed_to array<string>, nth int",
    )
    asked = spark.createDataFrame([(1, "LEADING", "c", "p"), (2, "leads", "c", "f"), (3, "led by", "f", "c"), (4, "rivals", "p", "c"), (5, "hates", "c", "c"), (6, "near", "c", "c")], "id int, label string, source string, target string")
    similar = spark.createDataFrame([(6, "s", 0.9), (5, "s", 0.5)], "id int, type string, similarity double")
    got = rows(matching.relation_types(asked, types, similar), "id")
    assert got == [(1, "existing", "b", False), (2, "widen-proposed", "b", False), (3, "existing", "a", True), (4, "new-proposed", "s", False), (5, "new-proposed", None, False), (6, "reuse-proposed", "s", False)]


def test_bands(spark):
    pairs = spark.createDataFrame([(0.9, True), (0.9, False), (0.6, True), (0.6, False), (0.1, True), (0.1, False)], "similarity double, same boolean")
    got = matching.band_costs(pairs, [0.8], [0.5, 0.8]).orderBy("new_below").collect()
    assert [(r["correct_matches"], r["correct_news"], r["false_merges"], r["false_splits"], r["asks_on_positives"], r["asks_on_negatives"], r["weighted_cost"], r["total_cost"]) for r in got] == [(1, 1, 1, 1, 1, 1, 6.0, 7.0), (1, 2, 1, 2, 0, 0, 7.0, 7.0)]
    jitter = spark.createDataFrame([("e", 0.801, 0.01, False), ("a", 0.801, 0.01, True), ("n", 0.65, 0.0, True)], "id string, similarity double, spread double, same boolean")
    assert rows(matching.fragile(jitter, 0.8, 0.5), "id") == [("a", "ask"), ("e", "error")]


def test_retrieval(spark):
    hits = spark.createDataFrame([("q", 1, 0.5, "http://A/x"), ("q", 2, 0.48, "http://b/y"), ("q", 3, 0.3, "c")], "query_id string, vec_id int, score double, url string")
    patterns = spark.createDataFrame([("http://a/*",), ("C",), (None,)], "pattern string")
    assert rows(retrieval.not_excluded(hits, "url", patterns).select("vec_id")) == [(2,)]
    assert rows(retrieval.not_excluded(hits, "url", patterns.limit(0)).select("vec_id"), "vec_id") == [(1,), (2,), (3,)]
    two = spark.range(1).select(retrieval.keyword_count(F.lit("Perché la Città?"), F.array(F.lit("città"), F.lit("Città"), F.lit("x"))).alias("n")).first()["n"]
    assert two == 2
    gold = spark.createDataFrame([("q", 2), ("q", 9), ("z", None)], "query_id string, vec_id int")
    got = retrieval.quality(hits, gold, 2, 0.4).orderBy("query_id").collect()
    assert [(r["reciprocal_rank"], r["recall_at_1"], r["recall_at_3"], r["survivors"], r["irrelevant"]) for r in got] == [(0.5, 0.0, 0.5, 2, 1), (0.0, 1.0, 1.0, 0, 0)]


def test_many_patterns_meet_by_their_lead(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_PATTERNS", 0)
    urls = spark.createDataFrame([("abcdefghijklmnop",), ("xyz",), ("",)], "url string")
    patterns = spark.createDataFrame([("abcdefghijklmno*",), ("*y*",)], "pattern string")
    assert rows(retrieval.not_excluded(urls, "url", patterns)) == [("",)]


def test_folds(spark):
    steps = spark.createDataFrame([("a", 1, 6.0, 10.0), ("a", 2, 5.0, 10.0), ("a", 3, 4.0, 10.0), ("b", 1, 11.0, 10.0), (None, 1, 1.0, 1.0)], "job string, n int, cost double, budget double")
    assert rows(writes.spent(steps, "job", "n", "cost", "budget").select("job", "n", "accepted", "spent"), "job", "n") == [("a", 1, True, 6.0), ("a", 2, False, 6.0), ("a", 3, True, 10.0), ("b", 1, False, 0.0)]
    gates = spark.createDataFrame(
        [("a", 1, 8.0, 8.0, False, 10.0, 5.0), ("a", 2, 5.0, 3.0, False, 10.0, 5.0), ("a", 3, 5.0, 1.0, True, 10.0, 5.0), ("b", 1, 5.0, 5.0, True, 10.0, 5.0), ("b", 2, 6.0, 1.0, False, 10.0, 5.0), ("b", 3, 1.0, 1.0, False, 10.0, 5.0)],
        "job string, n int, worst double, cost double, proposes boolean, budget double, reserve double",
    )
    got = writes.gated(gates, "job", "n", "worst", "cost", "proposes", "budget", "reserve")
    assert rows(got.select("job", "n", "allowed"), "job", "n") == [("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, True), ("b", 2, False), ("b", 3, False)]


def test_transitions_and_repeats(spark):
    log = spark.createDataFrame([("p", i, a) for i, a in enumerate(["accept", "accept", "reject", "undo", "reject", "odd"])], "k string, n int, a string")
    assert rows(writes.transitions(log, "k", "n", "a").select("state", "valid"), "n") == [("accepted", True), ("accepted", True), ("accepted", False), ("pending", True), ("rejected", True), ("rejected", False)]
    calls = spark.createDataFrame([("d", i, c) for i, c in enumerate(['{"b":1,"a":[2,{"z":1,"y":null}]}', '{"a":[2.0,{"y":null,"z":1}],"b":1}', '{ "b" : 1, "a":[2,{"z":1,"y":null}]}', '{"b":1,"a":[2,{"z":1,"y":null}]}', "x"])], "g string, n int, c string")
    got = writes.repeats(calls, "g", "n", F.coalesce(writes.canonical_json(F.col("c")), F.col("c")))
    assert rows(got.select("run", "verdict"), "n") == [(1, None), (2, None), (3, "warn"), (4, "end"), (1, None)]


def test_accepting(spark):
    entities = spark.createDataFrame([("e1", "rat", "Rat", "old"), ("e2", "keep", "Keep", "stone")], "entity string, slug string, name string, body string")
    accepted = spark.createDataFrame(
        [(1, "update", "e1", None, None, "new", 5), (2, "flag", "e2", None, "X", "X", 6), (3, "create", None, "rat", "Rat II", None, 7), (4, "create", None, "inn", "Inn", "b", 8), (5, "create", None, "inn", "Inn 2", None, 9), (6, "update", "gone", None, "Y", "Y", 9)],
        "proposal int, kind string, entity string, slug string, name string, body string, decided int",
    )
    assert rows(writes.accepted_revisions(entities, accepted), "slug") == [("new-4", "inn", "Inn 2", "b", 2), ("e2", "keep", "Keep", "stone", 0), ("e1", "rat", "Rat II", "new", 2)]


def test_publishing(spark):
    entities = spark.createDataFrame([("s1", "session", "players"), ("s2", "session", "players"), ("a", "place", "players"), ("h", "place", "gm_only")], "slug string, type string, visibility string")
    plan = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("a", "h"), ("s1", "x")], "session string, slug string")
    assert rows(writes.publish_problems(plan, entities), "slug", "problem") == [("a", "duplicated"), ("a", "not a session"), ("h", "hidden"), ("x", "missing")]
    sessions = spark.createDataFrame([("s1", 1), ("s2", 2)], "session string, nth int")
    relations = spark.createDataFrame([("a", "b"), ("a", "zz")], "source string, target string")
    assert rows(writes.revealed_relations(spark.createDataFrame([("s1", "a"), ("s2", "b")], "session string, slug string"), relations, sessions)) == [("a", "b", "s2")]


def test_debounced_rows(spark):
    at = lambda s: dt.datetime(2026, 1, 1, 0, s // 60, s % 60)
    log = spark.createDataFrame([("k", at(0), "a", "b"), ("k", at(3), "b", "c"), ("k", at(20), "c", "d")], "k string, at timestamp, old string, new string")
    assert rows(writes.coalesced(log, ["k"], "at", "old", "new", "4 seconds"), "run_after") == [("k", "a", "c", at(7), 2), ("k", "c", "d", at(24), 1)]


def test_warming(spark):
    start = spark.createDataFrame([("u", "a", "consumption"), ("v", "a", "consumption"), ("u", "n", "nightly"), ("w", "n", "nightly"), ("u", "x", "write")], "universe string, entity string, trigger string")
    ring = spark.createDataFrame([(u, "a", n, d) for u in "uv" for n, d in (("b", 1), ("c", 2))], "universe string, entity string, near string, depth int")
    rates = spark.createDataFrame([("u", 0.1), ("v", None)], "universe string, rate double")
    active = spark.createDataFrame([("u",), ("v",)], "universe string")
    got = rows(writes.warmed(start, ring, rates, active), "universe", "entity")
    assert got == [("u", "a", "consumption"), ("u", "b", "consumption"), ("u", "n", "nightly"), ("u", "x", "write"), ("v", "a", "consumption"), ("v", "b", "consumption"), ("v", "c", "consumption")]


def test_quantiles_and_positions(spark):
    rng = random.Random(1)
    values = [(rng.choice("ab"), rng.randint(0, 30)) for _ in range(500)] + [("a", None), ("c", 5)]
    got = {r["g"]: (r["n"], r["quantile"]) for r in tallies.quantile(spark.createDataFrame(values, "g string, v int"), ["g"], "v", 0.9).collect()}
    for g in "abc":
        mine = sorted(v for h, v in values if h == g and v is not None)
        assert got[g] == (len(mine), mine[min(len(mine) - 1, int(0.9 * len(mine)))])
    placed = tallies.positions(spark.createDataFrame([(g, i) for i, (g, _) in enumerate(values)], "g string, i int"), "g", ["i"])
    assert all(p == sum(h == g for h, _ in values[: i + 1]) for g, i, p in rows(placed.select("g", "i", "position")))
    assert tallies.positions(placed.limit(0).drop("position"), "g", ["i"]).count() == 0


def test_pulse(spark):
    weeks = spark.createDataFrame([(0, 3), (2, 5), (12, 9), (-1, 9)], "weeks_ago int, n long")
    assert rows(tallies.pulse(weeks, 3, F.lit(1), F.lit(None))) == [("moving", [5, 0, 3], 8, 3, 5)]
    assert rows(tallies.pulse(weeks.limit(0), 2, F.lit(0), F.lit(None)).select("state", "total")) == [("unwritten", 0)]
    assert rows(tallies.pulse(weeks.limit(0), 2, F.lit(1), F.lit(None)).select("state")) == [("quiet",)]


def test_tree_positions_beyond_a_million(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("a", "r", 1_000_001), ("b", "r", 999_999), ("c", "r", 1_000_000)], "id string, parent_id string, position long")
    got = [r["id"] for r in graph.flatten(spark, nodes).orderBy("path").collect()]
    assert got == ["r", "b", "c", "a"]
    assert rows(graph.ancestors(nodes).where("id = 'a'")) == [("a", "r", 1)]


def test_browsing(spark):
    people = spark.createDataFrame([(1, "Ann", ["Boss"]), (2, "Boss", []), (3, "bossy", ["x"]), (4, "Carl", ["the boss", "Bossman", "boss"]), (5, "Dan", ["Bossman", "Bosso"])], "id int, name string, aliases array<string>")
    assert rows(browse.ranked_aliases(people, "name", "aliases", "boss", 8, "id").select("id", "rank", "matched_alias")) == [(2, 0, None), (3, 1, None), (1, 2, "Boss"), (4, 2, "boss"), (5, 3, "Bosso")]
    assert [r["id"] for r in browse.completions(people, "name", "aliases", " BOS ", 3, "id").collect()] == [2, 3, 1]
    assert [r["id"] for r in browse.completions(people, "name", "aliases", "", 2, "id").collect()] == [1, 2]
    assert browse.by_keys(people, "id", []).count() == 0 and browse.by_keys(people, "id", list(range(2000))).count() == 5 and browse.by_key(people, "id", 9).count() == 0
    assert [r["id"] for r in browse.streamed(people, "id")] == [1, 2, 3, 4, 5]


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path, monkeypatch):
    good = zipped([("a/b.txt", "one"), ("a/../x", "bad"), ("./a//b.txt", "two"), ("empty", "")])
    for name, data in (("good.zip", good), ("bad.zip", b"PK\x03\x04 no zip"), ("many.zip", zipped([(f"f{i}", "x") for i in range(5)]))):
        (tmp_path / name).write_bytes(data)
    found = archives.files(spark, f"file://{tmp_path}", "*.zip").withColumn("path", F.element_at(F.split("path", "/"), -1))
    got = rows(archives.entries(found).select("archive", "path", F.col("content").cast("string"), F.col("error").isNotNull()), "archive", "path")
    assert got[0][0] == "bad.zip" and got[0][3]
    assert got[1:4] == [("good.zip", None, None, True), ("good.zip", "a/b.txt", "two", False), ("good.zip", "empty", "", False)]
    assert sum(g[0] == "many.zip" for g in got) == 5
    read = archives.archive_entries(spark, f"file://{tmp_path}")
    assert sorted(map(str, read.collect())) == sorted(map(str, archives.entries(found).collect()))
    monkeypatch.setattr(archives, "BATCH_BYTES", 1)
    assert archives.archive_entries(spark, str(tmp_path)).count() == read.count() and archives.archive_entries(spark, f"{tmp_path}/none").count() == 0
    names = ["a\\b/./c", "/x", "c:/x", "a/../b", "", ".", "a\0b", "d//e", "\\x", "é:x", "..", "a/.."]
    shown = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", archives.entry_path(F.col("n")).alias("p"))
    assert [p for _, p in rows(shown, "i")] == list(map(archives.normal_path, names))
    listing = spark.createDataFrame([("a/b/c", 1), ("a/d", 2), ("e", 3), ("a/b/f", 4)], "path string, size int")
    assert rows(archives.listing(listing, "a/")) == [("a/b", "directory", None), ("a/d", "file", 2)]
    assert rows(archives.listing(listing, "")) == [("a", "directory", None), ("e", "file", 3)]


def test_source_types(spark):
    shapes = {
        "vault": ["n/.obsidian/x", "a.md"], "records": ["x.json", "b.txt"], "pair": ["json/a.json", "html/a.html"], "one": ["Page.html", "Page_files/i.png"], "md": ["a.md", "__MACOSX/b"], "pdf": ["X.PDF"], "docx": ["x.docx"], "any": ["x.docx", "y.pdf"],
    }
    paths = spark.createDataFrame([(k, p, k == "records" and p == "x.json") for k, ps in shapes.items() for p in ps], "archive string, path string, shaped boolean")
    got = {r["archive"]: (r["kind"], r["confident"]) for r in archives.source_types(paths, record_shaped="shaped").collect()}
    assert got == {"vault": ("obsidian", True), "records": ("kanka", True), "pair": ("world-anvil", True), "one": ("onenote", True), "md": ("obsidian", False), "pdf": ("pdf", True), "docx": ("docx", True), "any": ("generic", False)}


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="", extra="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{extra}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    item = "<w:numPr/>"
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b  c") + "</w:tc></w:tr></w:tbl>"
    xml = f"<w:document {w}><w:body>{p('Title', 'Heading1')}{p('Text &amp; more')}{p('x', extra=item)}{p('y', extra=item)}{p('')}{table}{p('End', 'Heading9')}</w:body></w:document>"
    docs = spark.createDataFrame([(1, bytearray(zipped([("word/document.xml", xml)]))), (2, bytearray(b"junk")), (3, None)], "id int, content binary")
    assert rows(docs.select("id", archives.docx_text(F.col("content"))), "id") == [(1, "# Title\n\nText & more\n\n- x\n- y\n\n| a | b c |\n\n###### End\n"), (2, None), (3, None)]


def test_pdf_pages(spark):
    items = [("d", 1, 0, "Hel", 0.0, 5.0, 3.0, 10.0, False), ("d", 1, 1, "lo", 3.1, 5.0, 2.0, 10.0, False), ("d", 1, 2, "you", 9.0, 5.0, 3.0, 10.0, True), ("d", 1, 3, "next", 0.0, 20.0, 4.0, 10.0, True), ("d", 2, 0, "p2", 0.0, 0.0, 1.0, 10.0, False)]
    got = archives.page_text(spark.createDataFrame(items, "document string, page int, nth int, text string, x double, y double, width double, size double, line_end boolean"))
    assert rows(got) == [("d", "--- page 1 ---\n\nHello you\nnext\n\n--- page 2 ---\n\np2")]


def test_decoding(spark):
    texts = [(0, b"\xef\xbb\xbfh\xc3\xa9"), (1, b"\xff\xfeh\x00\xe9\x00"), (2, b"\xfe\xff\x00h\x00\xe9"), (3, b"h\xff"), (4, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in texts], "i int, b binary").select("i", archives.decoded(F.col("b")).alias("d"))
    assert rows(df.select("d.text", archives.reads_as_text(F.col("d.text"))), "i") == [("hé", True), ("hé", True), ("hé", True), ("h�", False), (None, None)]
    cut = spark.createDataFrame([(bytearray(b"abcdef"),)], "b binary").select(archives.decoded(F.col("b"), 4).alias("d"))
    assert rows(cut.select("d.text", "d.truncated")) == [("abcd", True)]


def test_connectors(spark, tmp_path):
    content = '[{"entity_id":1,"entity_type":"character","name":"A","entry":"<p>x <b>y</b></p>","relations":[{"target_id":2,"relation":"Leads"},{"target_id":9,"relation":"Leads"}]},{"entity_id":"2","entity_type":"family","name":"B"},{"entity_id":3,"entity_type":"map","name":"M"},{"entity_type":"item"}]'
    docs = spark.createDataFrame([("f.json", content), ("bad.json", "{"), ("n.json", None)], "path string, content string")
    entities, relations = connectors.records(docs)
    assert rows(entities.select("type", "name", "summary"), "name") == [("character", "A", "x y"), ("faction", "B", "B appears in this export.")]
    assert rows(relations) == [("f.json", 0, 1, "leads", "led by")]
    free = spark.createDataFrame([("x/locations/y.md", "# Head\n[[A|b]] text"), ("/locations/z.txt", "\n\nonly"), ("e", " \n")], "path string, content string")
    assert rows(connectors.free_texts(free).select("type", "name", "summary"), "name") == [("place", "Head", "A text"), ("place", "z", "only")]
    vault = spark.createDataFrame([("a/N.md", "# N\nx"), ("b/N.md", "y"), (".obsidian/N.md", "z"), ("c.txt", "q")], "path string, content string")
    more = spark.createDataFrame([("c/O.md", "intro\n#  Real title \nbody"), ("e.md", "---\na: b\n---\n  \n"), ("f.md", "# Only a title")], "path string, content string")
    assert rows(connectors.vault(vault.union(more)).select("title", "text"), "title") == [("N", "x"), ("N (b/N.md)", "y"), ("Real title", "intro\nbody")]
    broken = spark.createDataFrame([("no front",), ("---\nx\n---\n\nb",)], "text string")
    assert {r["error"] for r in connectors.parsed_markdown(broken).collect()} == {"malformed front"}


def test_collections(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "u"), (2, [0.0, 1.0], "v")], "id int, vector array<double>, universe string")
    assert vectors.ready(None, points.limit(0), 2).count() == 0 and vectors.ready(points, points.limit(0), 2).count() == 2
    with pytest.raises(ValueError, match="another size"):
        vectors.ready(points, points.limit(0), 3)
    with pytest.raises(ValueError, match="metric"):
        vectors.ready(points, points.limit(0), 2, "Other")
    assert vectors.ready(points, points.limit(0), 3, recreate=True).count() == 0
    assert vectors.upserted(points, points.limit(0)).count() == 2
    assert fn.slug(F.lit("x")) is not None


def test_edges_merge_and_rows_swap(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("a", "c", "x"), ("d", "e", None)], "source string, target string, type string")
    out, counts = writes.merged_edges(edges, "x", "y")
    assert rows(out, "source", "target") == [("a", "b", "y"), ("a", "c", "y"), ("d", "e", None)] and rows(counts) == [(1, 1)]
    tree = spark.createDataFrame([("p", 1, 0), ("p", 2, 1), ("p", 3, 2)], "parent string, id int, position int")
    moves = spark.createDataFrame([(1, True), (3, True)], "id int, up boolean")
    assert rows(writes.swapped(tree, "parent", "position", moves, "id").select("id", "position"), "id") == [(1, 0), (2, 2), (3, 1)]
