"""Each stage of the corpus pipeline against a plain version, on rows with nulls, repeated ids, ties, clashing columns and long texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamspark.llm import op2_toxicity, op3_mixing, op5_packing
from loamspark.llm.tokens import default_vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def make_rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs" for d in "ao"]
    rows = [(i, " ".join(rng.choice(vocabulary, 40)) + (" vilewordx nastytermy" if i % 9 == 0 else ""), "en", f"s{i % 3}", 1, -5.0) for i in range(400)]
    base = rows[1][1].split()
    rows += [
        (500, " ".join([*base, "more"]), "en", "s1", 1, 0.0),  # a near copy of 1
        (500, "another text under the same id as a near copy", "en", None, 1, 0.0),
        (2, "a second text with the id of 2 that copies nothing", "de", "s0", 1, 0.5),
        (3, rows[3][1], "en", "s0", 1, 0.5),  # row 3 once more
        (501, None, None, "s2", None, None),
        (None, rows[4][1], "en", "s2", 1, None),
        (None, "", "en", None, 1, None),
        (502, "", "en", "s4", 1, None),
        (503, " ".join(f"w{i}" for i in range(9000)), "en", "s1", 1, None),
        (504, "x" * 30000, "en", "s1", 1, None),
        (504, "x" * 30000, "en", "s1", 1, None),
    ]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = make_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 9 == 0)) for i in range(400)] + [(None, 1), (10**6, 1), (7, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def shingles(text, n=5):
    w = WORDS.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_toxicity(spark, docs, folder):
    model = op2_toxicity.train_on_tables(spark, folder)
    assert model.features
    got = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns

    def keep(text):
        have = np.array([f in op2_toxicity.marked(text or "") for f in model.features])
        return (1 / (1 + np.exp(-(model.weights @ have + model.intercepts)))).mean() < op2_toxicity.THRESHOLD

    want = Counter(r for r in make_rows() if keep(r[1]))
    assert as_rows(got) == want and not any("vilewordx" in (r[1] or "") for r in want)
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), folder).count() == 0


def test_near_copies(spark, docs, folder):
    rows = make_rows()
    sets = [shingles(r[1]) if r[0] is not None else set() for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group) if sets[g]}
    got = as_rows(corpus_pipeline.keep_one_of_near_copies(spark, docs, folder))
    assert all(n == 1 or not shingles(r[1]) for r, n in got.items())
    want = Counter((first[g], g) if sets[g] else (rows[g][0], g) for g in set(group))
    assert sum(got.values()) == sum(want.values())
    assert Counter(r[0] for r in got.elements()) == Counter(i for i, _ in want.elements())
    texts = {r[1] for r in got}
    assert {"another text under the same id as a near copy", "a second text with the id of 2 that copies nothing", "", None} <= texts
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs.limit(0), folder).count() == 0


def test_near_copies_do_not_depend_on_the_partitioning(spark, docs, folder):
    one = corpus_pipeline.keep_one_of_near_copies(spark, docs.coalesce(1), folder)
    many = corpus_pipeline.keep_one_of_near_copies(spark, docs.repartition(7), folder)
    assert as_rows(one) == as_rows(many)


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        open_ = [s for s in order if s not in capped]
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return {**target, **{s: 2.0 * sizes[s] for s in capped}}
        capped |= over


def test_mixing(spark, docs, folder):
    rows = make_rows()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    targets = plain_targets(sizes)
    want, nth = Counter(), Counter()
    for r in rows:
        rate = min(2.0, targets[r[3]] / sizes[r[3]]) if sizes[r[3]] else 0
        key = (r[0], r[1], r[3])
        text = f"17:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}:{nth[key]}"
        nth[key] += 1
        draw = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) / 2**60
        n = math.floor(rate) + (draw < rate - math.floor(rate))
        if n:
            want[r] += n
    assert as_rows(corpus_pipeline.mix_sources(spark, docs, folder)) == want
    assert as_rows(corpus_pipeline.mix_sources(spark, docs.repartition(5), folder)) == want
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), folder).count() == 0


def test_repeats_meet_the_target(spark):
    rows = spark.createDataFrame([(None, "one two", "a")] * 3000 + [(1, "x y", "b")] * 3000, "doc_id long, text string, source string")
    got = op3_mixing.plan(rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.1 * r["target"] for r in got)


def packed_well(got, rows, tokenizer):
    lengths = []
    for text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        lengths += [op5_packing.CAPACITY] * (n // op5_packing.CAPACITY) + ([n % op5_packing.CAPACITY] if n % op5_packing.CAPACITY else [])
    assert sorted(got["length"]) == sorted(lengths)
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert list(one["offset"]) == list(np.cumsum(one["length"]) - one["length"]) and one["length"].sum() <= op5_packing.CAPACITY
    assert got["sequence_id"].nunique() <= math.ceil(sum(lengths) / op5_packing.CAPACITY) + 1


def test_packing(spark, docs, folder):
    from tokenizers import Tokenizer

    got = corpus_pipeline.pack_sequences(spark, docs, folder).toPandas()
    packed_well(got, [r[1] for r in make_rows()], Tokenizer.from_file(default_vocabulary()))
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), folder).count() == 0


def test_run(spark, folder, docs):
    from tokenizers import Tokenizer

    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
    rows = [r["text"] for r in kept.collect()]
    packed_well(corpus_pipeline.run(spark, folder).toPandas(), rows, Tokenizer.from_file(default_vocabulary()))


def test_special_strings_are_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y <|ENDOFTEXT|>", "plain", "<|endoftext|", "|> after a cut", "<|endoftext|>" * 3 + "é"]
    got = op5_packing.packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), default_vocabulary()).collect()
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
