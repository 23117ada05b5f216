"""The numbered operators against plain versions on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamspark.llm import jpeg, op1_licences, op2_toxicity, op3_mixing, op4_jaccard, op5_packing, op6_pitman_yor, op7_media, op8_sharding, op9_ann, op10_token_files
from loamspark.llm.tokens import default_vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(6000))
TEXTS = [None, "", " \t", "One two", "one TWO", "a b c d e f g", LONG, LONG + " end", " ".join(f"x{i % 40}" for i in range(300)), "Permission", "é ß 漢字", "a b c d e f g"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src" if i % 3 else None, "mine", 1) for i, t in enumerate(TEXTS)] + [(3, "One two", "src", "mine", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, rank int")


def words(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_licences(spark, docs):
    known = op1_licences.known_digests(spark)
    mit = op1_licences.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 X\n" + mit.upper().replace(",", " ,")), (2, None), (3, ""), (4, "text\nReleased under the MIT licence.\nmore")]
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in op1_licences.scan_documents(spark.createDataFrame(rows, "doc_id int, text string"), known).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "") and got[3] == (None, "") and got[4] == (None, "MIT (notice)")
    assert op1_licences.scan_documents(docs, known).count() == len(TEXTS) + 1


def test_toxicity_learns_from_positives(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    rows = [(i, " ".join(rng.choice(vocabulary, 60)) + (" vilewordx" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = op2_toxicity.train(table.where("doc_id % 3 <> 1"), table.select("doc_id", "toxic").where("doc_id % 3 <> 1"))
    got = op2_toxicity.score(table.where("doc_id % 3 = 1"), model).collect()
    assert all((r["score"] >= op2_toxicity.THRESHOLD) == (r["toxic"] == 1) for r in got)
    none = op2_toxicity.train(table.limit(0), table.select("doc_id", "toxic").limit(0))
    assert {r["score"] for r in op2_toxicity.score(table.limit(3), none).collect()} == {0.0}


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 4}" if i % 5 else None) for i in range(4000)]
    got = op3_mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    got["source"] = got["doc_id"].map({i: str(s) for i, _, s in rows})
    for _, group in got.groupby("source"):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) < 0.1 * group["target"].iloc[0]
    assert abs(got.drop_duplicates("source")["target"].sum() - 1.5 * got["size"].sum()) < 1


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, n, percent):
    rng = np.random.default_rng(n)
    texts = list(TEXTS)
    for size in (7, 12, 30, 120):
        base = [f"t{x}" for x in rng.integers(0, 10**6, size)]
        for _ in range(12):
            w = list(base)
            for at in rng.integers(0, size, rng.integers(0, 1 + size // 20) + 1):
                w[at] = f"u{rng.integers(0, 9)}"
            texts.append(" ".join(w[rng.integers(0, 2) :]))
    got = {r["doc_id"]: tuple(r)[1:4] for r in op4_jaccard.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n, percent).collect()}
    sets = [shingles(t, n) for t in texts]
    links = [[j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in enumerate(sets)]
    for i, a in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        assert got[i] == (len(a), min(seen), len(links[i]))
    assert op4_jaccard.join_documents(docs.limit(0), n, percent).count() == 0
    assert op4_jaccard.join_documents(docs, n, percent).count() == len(TEXTS) + 1


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    got = op5_packing.packed_documents(docs, default_vocabulary()).toPandas()
    tokenizer = Tokenizer.from_file(default_vocabulary())
    for i, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got["doc_id"] == i].drop_duplicates("piece").sort_values("piece")
        assert mine["length"].sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine["start"], mine["length"])] == list(mine["ids_crc32"])
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert list(one["offset"]) == list(np.cumsum(one["length"]) - one["length"]) and one["length"].sum() <= op5_packing.CAPACITY


def test_pitman_yor_sums_to_one(spark):
    rows = [(i, i < 30, " ".join(f"v{(i * k) % 7}" for k in range(20))) for i in range(33)] + [(33, True, None), (None, True, "v1")]
    got = op6_pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, train boolean, text string")).collect()
    train = [w for _, t, x in rows if t for w in [*words(x), None]]
    n, v = len(train), len(set(train))
    for r in got:
        text = dict((i, x) for i, _, x in rows)[r["doc_id"]]
        assert r["n_tokens"] == r["n_known"] == len(words(text)) + 1 and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(np.log10((train.count(w) + 1) / (n + v + 1)) for w in [*words(text), None]))
    assert op6_pitman_yor.perplexity(spark.createDataFrame(got)) < v
    ends = spark.createDataFrame([(1, True, f"{w}") for w in ("a", "b", "a")], "doc_id long, train boolean, text string")
    assert all(r["score"] < 0 for r in op6_pitman_yor.score_documents(ends).collect())
    assert op6_pitman_yor.score_documents(ends.limit(0)).count() == 0


def test_media_round_trip(spark, docs):
    stored = op7_media.store(docs)
    got = {r["doc_id"]: r for r in op7_media.described(stored).collect()}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = op7_media.padded(np.frombuffer(raw, np.uint8)).tobytes()
        assert got[i]["n_bytes"] == len(raw) and got[i]["payload_bytes"] == len(payload) and got[i]["tail_crc32"] == zlib.crc32(payload[-32:])
    shapes = op7_media.tensors(stored).collect()
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in shapes)
    assert jpeg.Picture(jpeg.encode(np.arange(256, dtype=np.uint8))).payload() == bytes(range(256))


def test_sharding(spark, docs):
    rows = docs.select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).alias("size"), F.col("text").alias("text_digest"))
    got = op8_sharding.interleave(rows, 4).toPandas()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(got) == len(TEXTS) + 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_ann_finds_the_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [None] * 16)]
    usable = op9_ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = op9_ann.search(usable.where("vec_id % 20 = 0"), usable, op9_ann.train(usable)).toPandas()
    for q, found in got.groupby("query_id"):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[:20]
        assert len(set(want) & set(found["vec_id"])) >= 18
    assert set(got["query_id"]) == set(range(0, 400, 20))


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/files"
    op10_token_files.write(docs, path, default_vocabulary())
    got = sorted(op10_token_files.index(spark, path).collect(), key=lambda r: r["start"])
    tokenizer, at = Tokenizer.from_file(default_vocabulary()), 0
    for r, (i, text) in zip(got, sorted([*enumerate(TEXTS), (3, "One two")], key=lambda x: x[0]), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    with pytest.raises(ValueError, match="damaged"):
        list(op10_token_files.unframe(op10_token_files.frame(b"abc")[:-1] + b"x\n"))
