"""The Pitman-Yor model: probabilities that sum to one, scores that partitions do not change, and what training gains."""

import numpy as np
import pytest

from loamspark.llm import op6_pitman_yor as op
from loamspark.llm.common import settings

SCHEMA = "doc_id long, train boolean, text string"


def corpus(n=120, words=30, seed=1):
    """Texts whose next word depends on the one before."""
    rng = np.random.default_rng(seed)
    follow = rng.integers(0, words, (words, 3))
    rows = []
    for i in range(n):
        w = [int(rng.integers(0, words))]
        for _ in range(40):
            w.append(int(follow[w[-1], rng.integers(0, 3)]))
        rows.append((i, i % 5 > 0, " ".join(f"v{x}" for x in w)))
    return rows


@pytest.mark.parametrize("half", [op.HALF_BUCKET, 300])  # with 300, frequent words are split and have several restaurants
def test_probabilities_sum_to_one(spark, monkeypatch, half):
    monkeypatch.setattr(op, "HALF_BUCKET", half)
    rows = corpus()
    known = [f"v{i}" for i in range(30)]
    rows += [(1000 + i, False, f"v3 {w}") for i, w in enumerate([*known, "unknown", ""])]
    store, begin, totals, plan = op.trained(spark.createDataFrame(rows, SCHEMA), 64)
    assert (len(plan.hot) > 0) == (half == 300)
    of: dict[int, dict] = {}
    for r in store.stored.where("bucket >= 0").collect():
        b = op.Bucket([p.asDict() for p in r["parts"]], plan.contexts, plan.hot)
        for word, context, p in zip(b.words[b.entry_word], b.entry_context, op.probabilities(b, r["bucket"], begin, totals, 3, 2, 6), strict=True):
            of.setdefault(int(context), {})[int(word)] = p
    sums = [sum(found.values()) for found in of.values() if len(found) == 32]
    assert sums and sums == pytest.approx([1.0] * len(sums), abs=0.02)
    assert all(sum(found.values()) < 1.02 for found in of.values())


def test_partitions_change_no_score(spark):
    rows = corpus() + [(500, False, None), (None, True, "v1"), (7, True, "v1 v2"), (7, True, "v1 v2")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = []
    for partitions, shuffles in ((1, "4"), (9, "7")):
        with settings(spark, {"spark.sql.shuffle.partitions": shuffles}):
            found.append(sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 9), round(r["base_score"], 9)) for r in op.score_documents(docs.repartition(partitions)).collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)


@pytest.mark.parametrize("half", [op.HALF_BUCKET, 300])
@pytest.mark.parametrize("rounds", [1, 3])
def test_totals_in_a_table_give_the_same_scores(spark, monkeypatch, half, rounds):
    monkeypatch.setattr(op, "HALF_BUCKET", half)
    rows = corpus(80) + [(500, False, None), (None, True, "v1"), (7, True, "v1 v2"), (7, True, "v1 v2"), (501, False, "unknown v3")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = []
    for listed in (64, 63):
        monkeypatch.setattr(op, "LISTED", listed)
        monkeypatch.setattr(op, "OWN", 4)  # fewer than a quarter of the restaurants
        found.append(sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["score"], 9), round(r["base_score"], 9)) for r in op.score_documents(docs, 64, rounds).collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert op.score_documents(docs.limit(0), 64).collect() == []


def test_training_gains(spark):
    rows = corpus()
    train = [x.split() for _, t, x in rows if t]
    n, v = sum(len(w) + 1 for w in train), len({w for x in train for w in x}) + 1
    counts: dict = {}
    for x in train:
        for w in [*x, None]:
            counts[w] = counts.get(w, 0) + 1
    scores = op.score_documents(spark.createDataFrame(rows, SCHEMA))
    held = scores.where("doc_id % 5 = 0")
    unigram = [np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for _, t, x in rows if not t for w in [*x.split(), None]]
    assert op.perplexity(held) < 0.35 * 10 ** -np.mean(unigram)  # three of thirty words follow each


def test_repeats_score_higher(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"r{x}" for x in rng.integers(0, 3000, 60)) for _ in range(200)]
    rows = [(i, True, t) for i, t in enumerate(texts)] + [(1000, False, texts[5]), (1001, False, " ".join(rng.permutation(texts[5].split())))]
    got = {r["doc_id"]: r["score"] for r in op.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1000] > got[1001] + 10
