"""Where operators once did less than the whole job."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamspark.functions import text as fn
from loamspark.operators import candidates, similarity
from loamspark.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_search_takes_each_20th_vector(spark):
    got = {r["query_id"] for r in registry.QUERIES["boosted_retrieval"](spark, FOLDER).select("query_id").collect()}
    ids = {r["vec_id"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id").collect()}
    assert len(got) > 10 and got <= {i for i in ids if i % 20 == 0}


def test_blocks_of_vectors_meet_once(spark, monkeypatch):
    monkeypatch.setattr(similarity, "POINT_BLOCK", 7)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    x = np.random.default_rng(3).normal(size=(60, 4)).round(1)
    x[5] = 0.0
    x[20:30] = x[20]
    rows = [(i, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)] + [(60, None, 1), (61, [1.0, float("nan"), 0.0, 0.0], 1), (62, [1.0, 1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    size = np.linalg.norm(x, axis=1)
    score = np.divide(x @ x.T, np.outer(size, size), out=np.zeros((60, 60)), where=np.outer(size, size) > 0).round(9)
    want = {(q, p, k + 1) for q in range(60) for k, p in enumerate(sorted((p for p in range(60) if p != q and score[q, p] >= 0.2), key=lambda p: (-score[q, p], p))[:12])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in similarity.best(vectors, vectors, 12, 0.2, []).collect()} == want
    label = [r[2] for r in rows]
    known = [(q, p) for q in range(60) for p in range(60) if p != q and None not in (label[q], label[p])]
    got = sum(r["n"] for r in similarity.pair_cells(vectors, vectors).collect())
    assert got == len(known)
    near = similarity.nearest(vectors, vectors, 2, -1.0, "label").collect()
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in near if r["query_id"] < 60} == {
        (q, p, k + 1) for q in range(60) if label[q] is not None for k, p in enumerate(sorted((p for p in range(60) if p != q and label[p] == label[q]), key=lambda p: (-score[q, p], p))[:2])
    }


def test_groups_that_cannot_matter_are_not_met(spark):
    """Clusters, copies, a zero vector, another width, repeated ids: the same rows as all pairs, and most groups of a query skipped."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = centres[np.arange(1500) % 20] + 0.1 * rng.normal(size=(1500, 16))
    x[700:760], x[5] = x[3], 0.0
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(9000, [1.0, 2.0], 0), (9001, [2.0, 1.0], 1), (40, centres[7].tolist(), 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ids, vec = np.array([r[0] for r in rows if len(r[1]) == 16]), np.array([r[1] for r in rows if len(r[1]) == 16])
    unit = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-300)
    asked = vectors.where("vec_id % 20 = 0")
    got = similarity.best(asked, vectors, 12, -2.0, []).toPandas()
    for q in set(ids[ids % 20 == 0]):
        score = np.round((unit[ids == q] @ unit.T), 12)
        pairs = sorted({(-s, i, n) for row in score for n, (s, i) in enumerate(zip(row, ids, strict=True)) if i != q}) if (ids == q).sum() == 1 else None
        mine = got[got.query_id == q].sort_values("rank")
        if pairs is not None:
            want = [(i, -s) for s, i, _ in pairs[:12]]
            assert np.allclose(mine.score, [s for _, s in want], atol=1e-9) and len(mine) == 12
            assert set(mine.vec_id[mine.score > want[-1][1] + 1e-9]) == {i for i, s in want if s > want[-1][1] + 1e-9}
    assert sorted(got[got.query_id == 9000].vec_id) == [9001]
    queries, _, groups = similarity.grouped(asked, vectors, [])
    near = queries.join(groups, "width").withColumn("nearest", similarity._nearest())
    least = got.groupby("query_id").score.min().to_dict()
    rows_ = [(r["vec_id"], math.cos(r["nearest"])) for r in near.select("vec_id", "nearest").collect()]
    assert sum(c >= least.get(q, -2.0) - 1e-9 for q, c in rows_) < 0.3 * len(rows_)


def test_owners_by_blocks_as_by_brute_force(spark, monkeypatch):
    """Several blocks of either side, ties of sets and of owners, a null owner, large ids, sets and questions without tokens."""
    for name, size in {"QUERY_BLOCK": 3, "SET_BITS": 3, "HELD": 2}.items():
        monkeypatch.setattr(similarity, name, size)
    rng = np.random.default_rng(9)
    some = lambda n: sorted(set(rng.choice(list("abcdefghijkl"), rng.integers(0, n)).tolist()))
    sets = [(None if i % 17 == 0 else 2**60 + i % 29, i % 5, i // 29, some(6)) for i in range(200)] + [(1, 0, 0, None)]
    asked = [(q, some(9)) for q in range(20)] + [(None, ["a"]), (30, ["z"]), (31, None)]
    frames = spark.createDataFrame(sets, "owner long, text long, at int, tokens array<string>").repartition(3), spark.createDataFrame(asked, "question int, tokens array<string>")
    want = set()
    for q, tokens in asked:
        best = {}
        for owner, text, at, mine in sets:
            both = len(set(mine or ()) & set(tokens or ()))
            if q is not None and both:
                row = (-both / len({*mine} | {*tokens}), at, text)
                best[owner] = min(best.get(owner, row), row)
        order = sorted(best.items(), key=lambda x: (x[1][0], x[0] is not None, x[0]))[:4]
        want |= {(q, owner, text, at, -score, k + 1) for k, (owner, (score, at, text)) in enumerate(order)}
    got = [tuple(r) for r in similarity.best_owners(*frames, 4).collect()]
    assert len(got) == len(want) > 60 and set(got) == want
    # counted in many parts, in this process
    wanted = pa.array([{"question": q, "tokens": t} for q, t in asked if q is not None and t], pa.struct({"question": pa.int32(), "tokens": pa.list_(pa.string())}))
    said = pa.array([{"owner": o, "text": t, "at": a, "tokens": " ".join(w or ())} for o, t, a, w in sets], pa.struct({"owner": pa.int64(), "text": pa.int64(), "at": pa.int64(), "tokens": pa.string()}))
    monkeypatch.setattr(similarity, "MEETINGS", 5)
    block = similarity._Asked(wanted, 4)
    block.meet(said.slice(0, 77))
    block.meet(said.slice(77))
    found = block.rows(pa.int64()).to_pylist()
    assert {(*r.values(),) for r in found} == {r[:5] for r in want} and len(found) == len(want)


def test_own_canon_works_out_a_sentence_once_and_keeps_it_home(spark, monkeypatch):
    """neither sentences nor arrays of words are written or dealt out; rows with one id are one entity, exact copies of a row included."""
    frames, keep = [], similarity.kept
    monkeypatch.setattr(similarity, "kept", lambda df, label: frames.append(df) or keep(df, label))
    bodies = [("a", "Red fox. Red fox ran."), ("a", "Blue fox. Red fox ran far."), ("b", "Red fox ran."), ("b", "Red fox ran."), ("c", None), ("d", "A the of.")]
    asked = spark.createDataFrame([(1, "The red fox ran far"), (2, "of the")], "question int, text string")
    got = candidates.own_canon(spark.createDataFrame(bodies, "entity string, body string"), asked, "en", 3).select("question", "entity", "statement", "rank").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "Red fox ran far.", 1), (1, "b", "Red fox ran.", 2)]
    plan = frames[-1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "array_except" not in plan
    assert all("sentence" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "collect_list" in line)


def test_content_words_as_by_a_set_difference(spark):
    texts = spark.createDataFrame([("The Fox's fox, the FOX's 3rd of a",), ("",), (None,), ("of the and",)], "t string")
    plain = lambda locale: F.array_except(fn.ascii_words(F.col("t")), F.array(*map(F.lit, fn.function_tokens(locale))))
    for locale in ("en", "it"):
        assert texts.where(~fn.content_words(F.col("t"), locale).eqNullSafe(plain(locale))).count() == 0
