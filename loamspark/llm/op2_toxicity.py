"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are positives; a hash-drawn sample of texts, whatever they are, is unlabelled. Features are character n-grams and
words (a word's ends marked), chosen by how much more often they occur in positives than in unlabelled texts; a text has a feature or not,
however long it is. Linear classifiers are trained with numpy on the risk estimate

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss, one per bag of the sample, in parallel; the score is the mean of their probabilities. Where the second term falls
below zero, its gradient is followed backwards, as the estimator asks. The class prior is the share of toxic rows among the labels that
may be learnt from.

Bounds (parameters): at most ``max_positive`` positives and ``max_unlabelled`` unlabelled texts are learnt from, rows in order of a seeded hash of
their ids and of a digest of their texts, however many rows an id has; at most ``max_features`` features are kept. Scoring covers every whole text, of any length; words of any length are features.

Defined results: null and empty texts have no feature and get the score of the intercept; with no positives to learn from, every score is 0;
labels that are null, or of ids that are not in the documents, teach nothing; repeated rows are scored each and teach once, and different texts of one id
are texts each; ties of the draw go to the smaller id; an empty table gives no rows; extra columns are not read, and the score's column must have a name of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, doc_text, seeded_draw, small_batches, table, text_digest

BREAK = re.compile(r"[\W\d_]+")
GRAMS = (4, 5)
#: Of the unlabelled texts with a feature, so many must be toxic by the prior and the feature's shares.
LEAST_PURITY = 0.6
#: A bag has about so many positives; there are this many bags at most.
BAG_POSITIVES, MAX_BAGS = 500, 4


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray  # bags x features
    intercepts: np.ndarray  # bags


def marked(text: str) -> str:
    """The letters of a text in lower case, every run of others a '#'."""
    return f"#{BREAK.sub('#', text.lower())}#"


def features_of(text: str) -> set[str]:
    """n-grams of each distinct word with its ends marked, and the word itself."""
    found: set[str] = set()
    for word in set(marked(text).split("#")):
        if word:
            whole = f"#{word}#"
            for n in GRAMS:
                found.update(whole[i : i + n] for i in range(len(whole) - n + 1))
            found.add(whole)
    return found


def automaton(features: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, feature in enumerate(features):
        a.add_word(feature, i)
    if features:
        a.make_automaton()
    return a


def present(finder, text: str) -> np.ndarray:
    """Which features a text has. A word's features stand in its marked form."""
    if not len(finder):
        return np.zeros(0, np.int64)
    return np.fromiter({i for _, i in finder.iter(marked(text))}, np.int64)


def sample(texts: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int, seed: int) -> DataFrame:
    """doc_id, positive (1 or 0), text. texts has doc_id, text; labels has doc_id, toxic. A row is drawn by a hash of its id."""
    draw = seeded_draw(seed, F.col("doc_id"))
    kinds = ((1, max_positive, labels.where("toxic = 1")), (0, max_unlabelled, texts))
    # the first rows in order of draw are of the first ids in order of draw, so the bounds bound both lists
    ids = [k.select("doc_id").distinct().orderBy(draw, "doc_id").limit(n).withColumn("positive", F.lit(p)) for p, n, k in kinds]
    rows = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select("doc_id", "positive", "text", text_digest().alias("digest"))
    key = ["doc_id", "positive", "digest"]
    first = [rows.where(F.col("positive") == p).select(*key).distinct().orderBy(draw, "doc_id", "digest").limit(n) for p, n, _ in kinds]
    return rows.join(F.broadcast(first[0].unionByName(first[1])), key).dropDuplicates(key).select("doc_id", "positive", "text")


def choose(rows: DataFrame, n1: int, n0: int, prior: float, max_features: int, least_z: float) -> list[str]:
    """The features that set positives apart, by the z value of the difference of their shares; at least so pure by prior * p1 / p0."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for frame in frames:
            for positive, text in zip(frame["positive"], frame["text"], strict=True):
                seen[positive].update(features_of(text))
        for positive, counter in seen.items():
            if counter:
                yield pd.DataFrame({"feature": list(counter), "positive": positive, "n": list(counter.values())})

    counts = rows.select("positive", "text").mapInPandas(count, "feature string, positive int, n long")
    by = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("positive") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    p1, p0 = F.col("n1") / n1, F.col("n0") / n0
    pooled = (F.col("n1") + F.col("n0") + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    best = by.where((prior * p1 >= LEAST_PURITY * p0) & (F.col("n1") >= 3)).withColumn("z", z).where(F.col("z") >= least_z)
    return [r["feature"] for r in best.orderBy(F.desc("z"), "feature").limit(max_features).collect()]


def fit_nnpu(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk, by Adam on the full bag."""
    w = np.zeros(x_p.shape[1] + 1)
    a_p, a_u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (x_p, x_u))
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -50, 50)))
    for t in range(1, steps + 1):
        s_p, s_u = a_p @ w, a_u @ w
        q_p, q_u = sigmoid(s_p), sigmoid(s_u)
        rest = np.logaddexp(0, s_u).mean() - prior * np.logaddexp(0, s_p).mean()
        g_rest = a_u.T @ q_u / len(a_u) - prior * (a_p.T @ q_p) / len(a_p)
        g_plus = prior * (a_p.T @ (q_p - 1)) / len(a_p)
        g = g_plus + g_rest if rest >= 0 else -g_rest
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(texts: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000, max_features: int = 1024, least_z: float = 4.5, seed: int = 2) -> Model:
    """Learn from texts (doc_id, text) and labels (doc_id, toxic); the caller leaves out what must not be learnt from."""
    rows = sample(texts, labels, max_positive, max_unlabelled, seed).persist()
    try:
        known = labels.where("toxic is not null").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = min(max(known or 0.0, 1e-3), 0.5)
        totals = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
        n1, n0 = totals.get(1, 0), totals.get(0, 0)
        features = choose(rows, n1, n0, prior, max_features, least_z) if n1 and n0 else []
        if not features:
            return Model([], np.zeros((0, 0)), np.zeros(0))

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            finder = automaton(features)
            x = np.zeros((len(frame), len(features)), np.float32)
            for i, text in enumerate(frame["text"]):
                x[i, present(finder, text)] = 1
            positive = frame["positive"].to_numpy() == 1
            if not positive.any() or positive.all():
                return pd.DataFrame({"w": [], "b": []})
            w, b = fit_nnpu(x[positive], x[~positive], prior)
            return pd.DataFrame({"w": [w], "b": [b]})

        bag = seeded_draw(seed, F.col("doc_id")) % min(MAX_BAGS, max(1, n1 // BAG_POSITIVES))
        fitted = rows.withColumn("bag", bag).groupBy("bag").applyInPandas(fit, "w array<double>, b double").collect()  # one row per bag
        return Model(features, np.array([r["w"] for r in fitted]).reshape(len(fitted), len(features)), np.array([r["b"] for r in fitted]))
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a column ``out`` (which docs must not have) added: the probability that the text is toxic."""
    if out in docs.columns:
        raise ValueError(f"docs have a column {out} already")
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = automaton(model.features)
        for texts in batches:
            if not len(model.intercepts):
                yield pd.Series(np.zeros(len(texts)))
                continue
            found = [present(finder, text) for text in texts]
            logits = np.array([model.weights[:, f].sum(1) + model.intercepts for f in found]).reshape(len(found), -1)
            yield pd.Series((1 / (1 + np.exp(-np.clip(logits, -50, 50)))).mean(1))

    return docs.withColumn(out, probability(doc_text()))


def train_on_tables(spark: SparkSession, sf_dir: str) -> Model:
    """A model from the rows of documents and labels whose crc32(doc_id) modulo 3 is not 1."""
    mine = crc32_mod(F.col("doc_id"), 3) != 1
    texts = table(spark, sf_dir, "documents").where(mine).select("doc_id", doc_text().alias("text"))
    labels = table(spark, sf_dir, "labels").where(mine).select("doc_id", "toxic")
    return train(texts, labels)


#: From this score on a text counts as toxic.
THRESHOLD = 0.7


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_on_tables(spark, sf_dir)
    docs = score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return docs.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
