"""Queries of the numbered operators on whole tables: SQL where there is some, plain versions elsewhere; and inputs that are out of the way."""

import math
import textwrap
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamspark.llm import op1_licences, op2_toxicity, op5_packing, op8_sharding, op9_ann, op10_token_files, registry
from loamspark.llm.common import ARROW_ROWS, settings
from loamspark.llm.tokens import WordEncoder, default_vocabulary

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        return "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in found)


def same(got, want):
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, FOLDER), duck.execute(registry.SQL[name]))


def test_sharding_query(spark, duck):
    got = registry.QUERIES["op8_sharding"](spark, FOLDER)
    same(got.select("doc_id", "size", "shard", "slot"), duck.execute(op8_sharding.SQL))
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["law"] == "rows" for r in got.collect())


def test_sharding_tells_equal_ids_apart(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i:02d}", "a" if i % 2 else None, "mine") for i in range(40)], "doc_id long, text_digest string, source string, draw string")
    one, many = (op8_sharding.interleave(docs.repartition(n), 4) for n in (1, 7))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and one.columns == [*docs.columns, "shard", "slot"]
    assert op8_sharding.interleave(docs.limit(0), 4).count() == 0


def test_toxicity_query(spark):
    got = registry.QUERIES["op2_toxicity"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    model = op2_toxicity.train_on_tables(spark, FOLDER)
    texts = {r["doc_id"]: r["text"] for r in docs}
    for r in got:
        have = np.array([f in op2_toxicity.marked(texts[r["doc_id"]] or "") for f in model.features], bool)
        plain = (1 / (1 + np.exp(-(model.weights @ have + model.intercepts)))).mean() if model.features else 0.0
        assert r["score"] == pytest.approx(plain, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert len(got) == len(docs)


def test_toxicity_keeps_a_score_column(spark):
    docs = spark.createDataFrame([(1, "a", 2.0)], "doc_id long, text string, score double")
    model = op2_toxicity.Model([], np.zeros((0, 0)), np.zeros(0))
    with pytest.raises(ValueError, match="score"):
        op2_toxicity.score(docs, model)
    assert op2_toxicity.score(docs, model, "toxicity").select("score").first()[0] == 2.0


def test_long_words_are_features():
    word = "y" * 40
    assert f"#{word}#" in op2_toxicity.features_of(f"a {word}!")


def test_quantised_search_finds_the_nearest(spark):
    """A block larger than what is reranked: codes alone choose the candidates."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 32)).astype(np.float32)
    x[100:140] = x[7]
    vectors = spark.createDataFrame([(i, v.tolist(), "mine") for i, v in enumerate(x)] + [(7, x[7].tolist(), "again")], "vec_id long, embedding array<float>, block string")
    usable = op9_ann.usable(vectors)
    got = op9_ann.search(usable.where("vec_id % 20 = 0"), usable, op9_ann.train(usable), rerank=400).toPandas()
    found = 0
    for q, mine in got.groupby("query_id"):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[:20]
        found += len(set(want) & set(mine["vec_id"]))
        assert list(mine.sort_values("rank")["score"]) == sorted(mine["score"], reverse=True)
    assert found >= 0.9 * 20 * got["query_id"].nunique() and got["query_id"].nunique() == 250
    assert op9_ann.usable(vectors.limit(0)).count() == 0


def test_ann_of_no_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op9_ann.op9_ann(spark, f"file://{tmp_path}").collect() == []


def test_settings_are_as_before(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b"), (1, "a"), (None, "c"), (1, "a")], "doc_id long, text string")
    with settings(spark, {ARROW_ROWS: "777"}):
        op10_token_files.write(docs, f"file://{tmp_path}/f", default_vocabulary())
        got = op10_token_files.index(spark, f"file://{tmp_path}/f").orderBy("start").collect()
        assert spark.conf.get(ARROW_ROWS) == "777"
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2]


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op10_token_files, "FILE_BYTES", 110)
    docs = spark.createDataFrame([(None, "same text")] * 20 + [(5, f"t {i}") for i in range(10)] + [(6, "end " * 100)], "doc_id long, text string")
    op10_token_files.write(docs, f"file://{tmp_path}/f", default_vocabulary())
    got = op10_token_files.index(spark, f"file://{tmp_path}/f")
    files = got.groupBy("file").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size")).collect()
    assert len(files) >= 11 and all(r["size"] <= 110 or r["n"] == 1 for r in files)
    found = got.orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None] * 20 + [5] * 10 + [6]
    assert [r["start"] for r in found] == list(np.cumsum([0, *[r["n_tokens"] for r in found]])[:-1])


def test_more_words_than_the_table_has(monkeypatch):
    from loamspark.llm import tokens

    monkeypatch.setattr(tokens, "TABLE_BITS", 4)
    monkeypatch.setattr(tokens, "MAX_WORDS", 6)
    encoder = WordEncoder(default_vocabulary())
    text = " ".join(f"w{i}" for i in range(200))
    for one in (text, "a b c", text + " z", ""):
        raw = np.frombuffer(one.encode(), np.uint8)
        ids, counts = encoder.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == encoder.tokenizer.encode(one, add_special_tokens=False).ids and counts.sum() == len(ids)


def test_packing_is_near_the_lower_bound(spark):
    got = registry.QUERIES["op5_packing"](spark, FOLDER)
    total, used = got.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert used <= math.ceil(total / op5_packing.CAPACITY) + 1


def test_whole_licences(spark):
    known, texts = op1_licences.known_digests(spark), op1_licences.KNOWN
    wrapped = {n: textwrap.fill(t, 60) for n, t in texts.items()}
    i = texts["BSD-2-Clause"].index("THIS SOFTWARE IS")
    three = texts["BSD-2-Clause"][:i] + "3. Neither the name of Example, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + texts["BSD-2-Clause"][i:]
    files = {
        "MIT": ["MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrapped["MIT"], "The MIT License (MIT)\nCopyright 2020, Jane\nAll rights reserved.\n" + texts["MIT"].replace("The above copyright", "The above\ncopyright")],
        "ISC": ["# ISC License\n#\n# Copyright Jane Doe\n#\n" + textwrap.indent(wrapped["ISC"], "# "), "/*\n * Copyright (c) 2020 X\n *\n" + textwrap.indent(wrapped["ISC"], " * ") + "\n */"],
        "BSD-2-Clause": ["BSD 2-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + wrapped["BSD-2-Clause"].replace("1. R", "* R").replace("2. R", "* R")],
        "BSD-3-Clause": ["Copyright 2020 The Authors\n\n" + three],
    }
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if (path := Path("/usr/share/common-licenses", file)).exists():
            files[name] = [path.read_text(), textwrap.indent(path.read_text(), "// ", lambda _: True)]
    rows = [(name, text) for name, found in files.items() for text in found]
    other = [None, "", "Copyright law is old.", texts["MIT"] + " More.", "MIT License", texts["MIT"].replace("free of charge", "at a price")]
    got = op1_licences.scan_documents(spark.createDataFrame([*rows, *((f"none{i}", t) for i, t in enumerate(other))], "doc_id string, text string"), known).collect()
    assert sorted((r["doc_id"], r["licence"]) for r in got if not r["doc_id"].startswith("none")) == sorted((n, n) for n, _ in rows)
    assert [r["licence"] for r in got if r["doc_id"].startswith("none")] == [None] * len(other)
    forms = op1_licences.bare_digests(spark)
    assert forms.where("bare is null").count() == 0
