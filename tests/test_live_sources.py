"""Sources that are read bit by bit, the export that is whole or absent, table functions, and state with timers."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from loamspark.operators import proposals
from loamspark.sources import connectors, exports, live
from loamspark.streaming import timers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(autouse=True)
def sources(spark):
    for source in (live.AppendLog, live.WikiPages, exports.MarkdownExport):
        spark.dataSource.register(source)


def collected(stream, checkpoint):
    """Run a stream until all there is has been read, and stop it; the rows that it gave, in the order of its batches."""
    out = []
    query = stream.writeStream.foreachBatch(lambda batch, _: out.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return out


def test_append_log_backlog_and_restart(spark, tmp_path):
    log, checkpoint = f"file://{tmp_path}/log", f"{tmp_path}/cp"
    for start in range(0, 350, 50):
        assert live.publish(log, "u", [("note", f"d{i}", "t") for i in range(start, start + 50)]) == start + 50
    live.publish(log, "v", [("other", "x", "t")])
    table = spark.read.format("append_log").options(path=log, universe="u").load()
    assert [r["id"] for r in table.orderBy("id").collect()] == list(range(51, 351))
    late = spark.read.format("append_log").options(path=log, universe="u", since=345, backlog=300).load()
    assert rows(late.select("universe", "id", "data"), "id") == [("u", i, f"d{i - 1}") for i in range(346, 351)]
    stream = spark.readStream.format("append_log").options(path=log, universe="u", since=320).load().select("id", "data")
    assert sorted(collected(stream, checkpoint)) == [(i, f"d{i - 1}") for i in range(321, 351)]
    live.publish(log, "u", [("note", f"d{i}", "t") for i in range(350, 700)])  # more than the backlog while the reader is away
    assert sorted(collected(stream, checkpoint)) == [(i, f"d{i - 1}") for i in range(351, 701)]
    assert collected(stream, checkpoint) == []
    live.publish(log, "u", [("note", "last", "t")])
    assert collected(stream, checkpoint) == [(701, "last")]
    assert spark.read.format("append_log").options(path=log, universe="nobody").load().count() == 0


def test_wiki_by_continuation_tokens(spark, tmp_path):
    folder = live.Folder(f"file://{tmp_path}/wiki")

    def put(token, titles, follows=None):
        folder.write(json.dumps({"titles": titles} | ({"continue": follows} if follows else {})).encode(), "lists", f"{live.quote(token, safe='')}.json")

    for title in ("A", "B/c", "É"):
        folder.write(json.dumps({"title": title, "url": f"u:{title}", "wikitext": f"'''{title}'''", "updated_at": "2026"}).encode(), "pages", f"{live.quote(title, safe='')}.json")
    put("first", ["A", "gone"], "B/c")
    put("B/c", ["B/c"])
    assert rows(spark.read.format("wiki_pages").options(path=str(tmp_path / "wiki")).load().select("title", "wikitext"), "title") == [("A", "'''A'''"), ("B/c", "'''B/c'''"), ("gone", None)]
    stream = spark.readStream.format("wiki_pages").options(path=f"file://{tmp_path}/wiki", lists=1).load().select("title")
    assert sorted(collected(stream, f"{tmp_path}/cp")) == [("A",), ("B/c",), ("gone",)]
    put("B/c", ["B/c"], "É")
    put("É", ["É"])
    assert collected(stream, f"{tmp_path}/cp") == [("É",)]
    assert spark.read.format("wiki_pages").options(path=str(tmp_path / "nowhere")).load().count() == 0


ENTRY = "name string, type string, aliases array<string>, slug string, visibility string, created_at string, updated_at string, body string"


def entry(slug, body, name="N: \"q\""):
    return (name, "place", ["a", "é"], slug, "public", "2026-01-01", None, body)


def test_export_is_whole_or_absent(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    entries = spark.createDataFrame([entry(f"e-{i}", f"# B\n\n---\n\nline {i}\n") for i in range(40)], ENTRY).repartition(5)
    exports.export(entries, out, "World", "2026-01-02")
    assert sorted(os.listdir(tmp_path)) == ["out"]
    assert len(os.listdir(tmp_path / "out")) == 41 and "Entries: 40, 2026-01-02" in (tmp_path / "out/README.md").read_text()
    assert (tmp_path / "out/e-7.md").read_text() == rows(connectors.entry_markdown(entries).where("slug = 'e-7'").select("text"))[0][0]
    back = exports.exported(spark, out)
    assert rows(back.select(*connectors.FRONT, "body", "error"), "slug") == [(*r, None) for r in rows(entries.select(*connectors.FRONT, "body"), "slug")]
    with pytest.raises(Exception, match="there already"):
        exports.export(entries, out)
    exports.export(entries.limit(3), out, mode="overwrite")
    assert len(os.listdir(tmp_path / "out")) == 4


def test_failed_export_leaves_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    bad = spark.createDataFrame([entry(f"e-{i}", "b") for i in range(30)] + [entry("no/name", "b")], ENTRY).repartition(4)
    with pytest.raises(Exception, match="no name of a file"):
        exports.export(bad, out)
    assert os.listdir(tmp_path) == []
    twice = spark.createDataFrame([entry("e", "b"), entry("e", "c")], ENTRY).repartition(2)
    with pytest.raises(Exception, match="2 rows have 1 slugs"):
        exports.export(twice, out)
    assert os.listdir(tmp_path) == []


def test_export_task_that_outlives_the_failure(tmp_path):
    """Spark does not wait for tasks that it stops; one that still runs after the abort leaves nothing either."""
    writer = exports.MarkdownWriter({"path": f"file://{tmp_path}/out"}, False)

    def late():
        yield {"slug": "a", "text": "x"}
        writer.abort([])
        yield {"slug": "b", "text": "x"}

    with pytest.raises(FileNotFoundError):
        writer.write(late())
    with pytest.raises(FileNotFoundError):
        writer.write(iter([{"slug": "c", "text": "x"}]))
    assert os.listdir(tmp_path) == []


def test_proposals(spark):
    docs = spark.createDataFrame([("a", "intro\n# Rat \n\n old \nold\n# Cat\nold"), ("b", None), ("c", "## Only")], "id string, text string")
    got = proposals.proposed(docs, "id", "text")
    assert rows(got, "doc", "nth") == [("a", 1, None, "intro"), ("a", 2, "Rat", "old"), ("a", 3, "Cat", "old"), ("b", 1, None, None), ("c", 1, "Only", None)]
    many = [(str(i), "\n".join(f"# s{j % 3}\nline {(i * j) % 7}" for j in range(i))) for i in range(40)]
    want = []
    for doc, text in many:
        subject, said = None, {}
        for line in text.split("\n"):
            if line.startswith("#"):
                subject = line[1:].strip()
            elif line.strip():
                said.setdefault((subject, line.strip()), len(said) + 1)
        want += [(doc, n, *pair) for pair, n in said.items()] or [(doc, 1, subject, None)]
    assert sorted(rows(proposals.proposed(spark.createDataFrame(many, "id string, text string").repartition(3), "id", "text"))) == sorted(want)


def at(second):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=second)


def through(spark, tmp_path, schema, batches, make):
    """The rows that a stream of the batches gives, batch by batch."""
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([], schema).coalesce(1).write.parquet(source)
    stream = make(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.foreachBatch(lambda b, _: out.append([tuple(r) for r in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        found = []
        for batch in batches:
            if batch == "restart":
                query.stop()
                query = stream.writeStream.foreachBatch(lambda b, _: out.append([tuple(r) for r in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).start()
                continue
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
            found.append(sorted(r for rows_ in out for r in rows_))
            out.clear()
        return found
    finally:
        query.stop()


def test_grants_late_replayed_and_expired(spark, tmp_path):
    day = 86_400
    batches = [
        [("a", "1", at(0), 1, 10.0), ("a", "2", at(1), 3, 10.0), ("b", "9", at(0), 1, 1.0)],
        "restart",
        [("a", "1", at(2), 9, 10.0), ("a", "3", at(3), 2, 10.0), ("a", "4", at(4), 4, 5.0)],  # replayed, late, next
        [("b", "10", at(500 * day), 2, 1.0)],  # the watermark passes what a and b are kept for
        [("b", "11", at(500 * day + 1), 1, 1.0)],
        [("a", "5", at(500 * day + 2), 2, 7.0), ("a", "1", at(500 * day + 3), 3, 8.0)],  # a is forgotten
    ]
    got = through(spark, tmp_path, "account string, event_id string, ts timestamp, period long, amount double", batches, timers.grants)
    assert got == [
        [("a", "1", 1, 10.0), ("a", "2", 3, 10.0), ("b", "9", 1, 1.0)],
        [("a", "3", 2, 0.0), ("a", "4", 4, 5.0)],
        [("b", "10", 2, 1.0)],
        [("b", "11", 1, 0.0)],
        [("a", "1", 3, 8.0), ("a", "5", 2, 7.0)],
    ]


def test_bursts_fire_after_a_quiet_gap(spark, tmp_path):
    batches = [
        [("k", at(0), "first"), ("k", at(30), "x"), ("m", at(5), "m")],
        "restart",
        [("k", at(80), "last"), ("k", at(-1), "zero")],  # the timer moves, and a late one begins the burst
        [("k", at(200), "next")],
        [("z", at(2000), "z")],
        [("z", at(4000), "y")],
    ]
    got = through(spark, tmp_path, "key string, ts timestamp, value string", batches, lambda s: timers.debounced(s, "key", "ts", "value"))
    assert got[:2] == [[], []]
    assert sorted(r for g in got for r in g) == [
        ("k", at(-1), at(140), 4, "zero", "last"), ("k", at(200), at(260), 1, "next", "next"), ("m", at(5), at(65), 1, "m", "m"), ("z", at(2000), at(2060), 1, "z", "z"),
    ]
