"""Long repeats, the trie of conversations and importance resampling against plain versions; and inputs that are out of the way."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamspark.llm import op2_toxicity, op7_media, op9_ann, op10_token_files, op11_suffix_dedup, op12_prefix_trie, op13_importance, registry
from loamspark.llm.tokens import default_vocabulary

FOLDER = "/root/testdata/sf0.001"


# --- long repeats


def without_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(r, gone, strict=True) if not x)
        yield len(r), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "gram", "group_rows"), [(12, 4, 50_000), (12, 4, 1), (20, 9, 3), (30, 12, 50_000)])
def test_long_repeats(spark, length, gram, group_rows):
    """Random joins of parts, with groups that are sorted and groups that are counted; long periods; nulls, empty texts, repeated rows and ids, clashing columns."""
    rng = random.Random(length + group_rows)
    parts = ["".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 40))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 5))) for _ in range(100)]
    texts += [None, "", "a" * 500, "ab" * 300, *texts[:20]]
    docs = spark.createDataFrame([(i % 50 or None, t, i, "mine") for i, t in enumerate(texts)], "doc_id long, text string, d1 int, pos string").repartition(3)
    got = op11_suffix_dedup.dedup(docs, length, gram, group_rows).collect()
    want = [(i % 50 or None, *w) for i, w in enumerate(without_repeats(texts, length))]
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got))) == sorted(map(str, want))
    assert all(sum(e - s for s, e in zip(r["starts"], r["ends"], strict=True)) == r["n_removed"] for r in got)


def test_long_repeats_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, registry.QUERIES["op11_suffix_dedup"](spark, FOLDER).collect()))
    assert got == sorted((r["doc_id"], *w) for r, w in zip(docs, without_repeats([r["text"] for r in docs], 400), strict=True))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op11_suffix_dedup.dedup(empty).collect() == []


def test_anchors_in_pieces(monkeypatch):
    """Pieces change no anchor, also in a text of one byte over and over."""
    text = np.frombuffer(b"a" * 900 + bytes(range(256)) * 3 + b"ab" * 400, np.uint8)
    starts = np.array([0, 450, 1668, len(text)])
    whole = op11_suffix_dedup.anchors(text, starts)
    monkeypatch.setattr(op11_suffix_dedup, "PIECE", 37)
    pieces = op11_suffix_dedup.anchors(text, starts)
    assert whole[0].tolist() == pieces[0].tolist()


def test_deep_shallow_order():
    rng = random.Random(8)
    for _ in range(100):
        n, width = rng.randint(1, 40), rng.choice([8, 16, 32])
        m = np.array([[rng.choice([0, 1, 97]) if rng.random() < 0.1 else 97 for _ in range(width)] for _ in range(n)], np.uint8)
        group = np.sort(np.array([rng.randint(0, 4) for _ in range(n)]))
        order, common = op11_suffix_dedup.deep_shallow(m, group, rng.choice([0, 8, 24]))
        rows = [(group[i], m[i].tobytes()) for i in order]
        assert rows == sorted(rows)
        for a, b, c in zip([(None, b"")] + rows, rows, common, strict=False):
            assert c == (-1 if a[0] != b[0] else next((k for k in range(width) if a[1][k] != b[1][k]), width))


# --- the trie of conversations


def plain_trie(rows, most=6):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    members = collections.defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = own.get(c - int(math.fmod(c, 100)), [])
        whole[c] = tuple(t[2:] for t in base[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in convs if whole[c] == node)))
        yield (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node], sum(not kids[n] for n in below), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest())


def trie_rows(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("pos", F.lit("mine")).withColumn("name", F.lit(1))
    got = op12_prefix_trie.trie(*op12_prefix_trie.rebuilt(op12_prefix_trie.ordered_turns(frame.repartition(3))))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(str, map(tuple, got.collect())))


def test_trie(spark, monkeypatch):
    """Shared first turns, ties, nulls, negative ids, absent bases, turnless conversations, one of many turns; windows over slices of three."""
    monkeypatch.setattr(op12_prefix_trie, "SLICE", 3)
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["x", "é", "long text", "", None])) for c in [*range(40), *range(100, 110), 205, -3, -103] for t in range(rng.randint(1, 5))]
    rows += [(7, None, "user", "first"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "bot", "tie"), (None, 1, "user", "x")]
    rows += [(300, t, "user", f"turn {t}") for t in range(37)] + [(c, t, "user", f"turn {t}") for c in (301, 302) for t in range(c - 270)]
    want = sorted(map(str, plain_trie(rows)))
    assert trie_rows(spark, rows) == want
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(map(str, con.execute(op12_prefix_trie.SQL).fetchall())) == want


def test_trie_of_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert op12_prefix_trie.trie(*op12_prefix_trie.rebuilt(op12_prefix_trie.ordered_turns(empty))).collect() == []
    assert trie_rows(spark, [(205, 0, "user", "only turn of its own")]) == sorted(map(str, plain_trie([(205, 0, "user", "only turn of its own")])))


# --- importance resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(docs, target):
    found = [(i, *plain_features(t)) for i, t in docs]
    s, t = (collections.Counter(f for fs in lists for f in fs) for lists in ([x[2] for x in found], [plain_features(x)[1] for x in target]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + 10_000) / ((s[k] + 1) * (big_t + 10_000)))) for k in range(10_000)]
    rows = []
    for i, n, fs in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in fs)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = able[: 5 * len(able) // 100]
    ranks = [(*r, k + 1) for k, r in enumerate(drawn)]
    for r in drawn:
        rows.remove(r)
    return sorted(map(str, ranks + [(*r, None) for r in rows]))


def test_importance_query(spark):
    read = {n: spark.read.parquet(f"{FOLDER}/{n}.parquet").collect() for n in ("documents", "benchmark")}
    want = plain_draw([(r["doc_id"], r["text"]) for r in read["documents"]], [r["text"] for r in read["benchmark"]])
    got = op13_importance.resample(*(spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "benchmark"))).collect()
    assert sorted(map(str, map(tuple, got))) == want
    assert registry.QUERIES["op13_importance"](spark, FOLDER).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_importance_of_odd_rows(spark):
    """Words of any length, signs, characters beyond ASCII, repeated ids and rows, nulls, a long text, clashing columns, no target."""
    rng = random.Random(13)
    words = ["a", "Zebra9", "é" * 30, "x" * 49, "Y" * 50, "w" * 3000, "日本", "İ", "k's", "a-b_c", "\0n"]
    texts = [" ".join(rng.choice(words[:9] if n < 40 else words) for _ in range(rng.randint(0, n))) for n in [*range(60), *[60] * 60]]
    texts += [None, "", "...", " ".join(["long"] * 50_000)]
    docs = [(i % 90 or None, t, 1) for i, t in enumerate(texts)] + [(5, "same " * 30, 1)] * 40
    frame = spark.createDataFrame(docs, "doc_id long, text string, weight int").repartition(5)
    target = ["zebra9 a zebra9", None, ""]
    got = op13_importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(map(str, map(tuple, got))) == plain_draw([d[:2] for d in docs], target)
    none = spark.createDataFrame([], "text string")
    assert sorted(map(str, map(tuple, op13_importance.resample(frame, none).collect()))) == plain_draw([d[:2] for d in docs], [])
    assert op13_importance.resample(frame.limit(0), none).collect() == []


# --- earlier operators


def test_starts_go_by_numbers(spark):
    """1,001 files of a part and more, and part numbers of six digits: names do not sort so."""
    places = [(part, number) for part in (0, 7, 99_999, 100_000, 100_001) for number in range(1002 if part in (7, 100_000) else 2)]
    rows = [(f"part-{p:05d}-c0ffee00-1111-4222-8333-c12345678901-c{c:03d}.txt", 1000 * k + o, o, 17, 1 + (k + o) % 5, 0) for k, (p, c) in enumerate(places) for o in range(2)]
    frame = spark.createDataFrame(rows, "file string, doc_id long, offset long, n_bytes long, n_tokens long, ids_crc32 long").repartition(6)
    got = op10_token_files.started(frame).orderBy("doc_id").collect()
    assert [r["start"] for r in got] == np.cumsum([0, *[r[4] for r in rows]])[:-1].tolist()


def test_many_files_of_a_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op10_token_files, "FILE_BYTES", 1)
    docs = spark.range(1010).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).coalesce(1)
    monkeypatch.setattr(op10_token_files, "parallelism", lambda _: 1)
    op10_token_files.write(docs, f"file://{tmp_path}/f", default_vocabulary())
    got = op10_token_files.index(spark, f"file://{tmp_path}/f").orderBy("start").collect()
    assert len({r["file"] for r in got}) == 1010
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    op10_token_files.write(docs.limit(0), f"file://{tmp_path}/none", default_vocabulary())
    assert op10_token_files.index(spark, f"file://{tmp_path}/none").collect() == []


def test_sample_is_bounded_by_rows(spark):
    """Repeated ids with many texts, and rows that are equal in full."""
    rows = spark.createDataFrame([(i % 7, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(7)], "doc_id long, toxic int")
    got = op2_toxicity.sample(rows.union(rows), labels, 10, 20, 2).collect()
    assert {p: sum(r["positive"] == p for r in got) for p in (0, 1)} == {0: 20, 1: 10}
    assert len({(r["doc_id"], r["positive"], r["text"]) for r in got}) == 30
    again = op2_toxicity.sample(rows.union(rows).repartition(7), labels, 10, 20, 2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("factor", [1e12, 1e20, 1e30, 1e200])
def test_one_large_vector_costs_no_recall(spark, factor):
    x = np.random.default_rng(1).normal(size=(2000, 32))
    x[1237] *= factor
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0] * 31), (5020, [1.0] * 33)]
    usable = op9_ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = op9_ann.search(usable.where("vec_id % 20 = 0"), usable, op9_ann.train(usable), rerank=200).toPandas()
    found = 0
    for q, mine in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        found += len(set(np.lexsort((np.arange(2000), -score))[:20]) & set(mine["vec_id"]))
    assert found >= 0.9 * 20 * 100 and got["query_id"].nunique() == 100


def test_media_digests(spark):
    """The payload is the padded text, read back from the stored form; equal texts have equal values."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    by_text = {}
    for r in registry.QUERIES["op7_media"](spark, FOLDER).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert by_text.setdefault(raw, tuple(r)[3:]) == tuple(r)[3:]
    assert op7_media.__doc__


@pytest.mark.parametrize(("members", "size"), [(3, 1 << 24), (1024, 900), (2, 300)])
def test_lists_in_blocks_of_members_and_of_bytes(spark, monkeypatch, members, size):
    """A group of near copies, some of them long, whose list is dealt out in blocks; against all pairs."""
    from loamspark.llm import op4_jaccard

    monkeypatch.setattr(op4_jaccard, "BLOCK", members)
    monkeypatch.setattr(op4_jaccard, "BLOCK_BYTES", size)
    rng = random.Random(members)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.02 else rng.choice(base) for w in base) for _ in range(24)]
    texts += [" ".join(f"x{i}" for i in range(900 + k)) for k in range(4)]
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    near = [{j for j, b in enumerate(sets) if j != i and 100 * len(a & b) >= 85 * len(a | b)} for i, a in enumerate(sets)]
    reach = list(range(len(texts)))
    while (new := [min(reach[j] for j in (i, *near[i])) for i in range(len(texts))]) != reach:
        reach = new
    got = op4_jaccard.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    assert [(r["component_id"], r["n_links"]) for r in got] == [(c, len(n)) for c, n in zip(reach, near, strict=True)]


def test_empty_tables_and_long_texts(spark):
    """Empty tables give no rows; a text of a million words is scored and has a picture; other columns are not read."""
    from loamspark.llm import op1_licences, op6_pitman_yor

    docs = spark.createDataFrame([(1, "short one", True, 7.0, "mine"), (2, "word " * 1_000_000, False, 8.0, "mine"), (3, None, True, 9.0, "mine")], "doc_id long, text string, train boolean, score double, media string")
    assert op1_licences.scan_documents(docs.limit(0), op1_licences.known_digests(spark)).collect() == []
    assert op7_media.described(op7_media.store(docs.limit(0))).collect() == []
    assert op6_pitman_yor.score_documents(docs.limit(0)).collect() == []
    scores = {r["doc_id"]: r for r in op6_pitman_yor.score_documents(docs).collect()}
    assert scores[2]["n_tokens"] == 1_000_001 and scores[2]["score"] < 0 and scores[3]["n_tokens"] == 1
    media = {r["doc_id"]: r for r in op7_media.described(op7_media.store(docs)).collect()}
    assert media[2]["n_bytes"] == 5_000_000 and media[3]["payload_bytes"] == 576
