"""Sources that are read bit by bit: an append log of events with a bounded backlog, and a crawl of wiki pages by continuation tokens.

Register them with ``spark.dataSource.register(AppendLog)`` and so on. Readers open files themselves, on the driver to find offsets and on executors to read, so path must be a
URI that both reach (pyarrow's file systems: file on a shared mount, hdfs, s3 and others).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Events of a universe that a reader who was away can still get.
BACKLOG = 300


class Folder:
    """Files under a URI."""

    def __init__(self, uri: str):
        self.files, self.root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def at(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def names(self, *parts: str) -> list[str]:
        return sorted(f.base_name for f in self.files.get_file_info(fs.FileSelector(self.at(*parts), allow_not_found=True)) if f.is_file and not f.base_name.startswith("."))

    def read(self, *parts: str) -> bytes | None:
        if self.files.get_file_info(self.at(*parts)).type == fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(self.at(*parts)) as f:
            return f.read()

    def write(self, data: bytes, *parts: str) -> None:
        """Nobody sees half a file: it gets its name when it is whole."""
        self.files.create_dir(posixpath.dirname(self.at(*parts)), recursive=True)
        self.put(data, *parts)

    def put(self, data: bytes, *parts: str) -> None:
        """As write, into a folder that is there."""
        path = self.at(*parts)
        hidden = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}")
        with self.files.open_output_stream(hidden) as f:
            f.write(data)
        self.files.move(hidden, path)


# ---- the append log: a folder a universe, files of one event a line, named by their first id


def _lines(folder: Folder, universe: str, name: str) -> list[dict]:
    return [json.loads(x) for x in (folder.read(universe, name) or b"").decode().splitlines()]


def last_id(folder: Folder, universe: str) -> int:
    names = folder.names(universe)
    return _lines(folder, universe, names[-1])[-1]["id"] if names else 0


def publish(path: str, universe: str, events: list[tuple[str, str, str]]) -> int:
    """Append events (type, data, at) with the next ids, from 1; returns the last. One writer a universe."""
    folder = Folder(path)
    first = last_id(folder, universe) + 1
    lines = [json.dumps(dict(zip(("id", "type", "data", "at"), (first + i, *e), strict=True))) for i, e in enumerate(events)]
    if lines:
        folder.write("\n".join(lines).encode(), universe, f"{first:020d}.jsonl")
    return first + len(lines) - 1


@dataclass
class LogFile(InputPartition):
    name: str
    start: int
    end: int


class AppendLog(DataSource):
    """The events of a universe, in order of their ids.

    Options: path, universe, since (an id, 0: none seen), backlog. Who starts gets of the latest ``backlog`` events those after ``since``; then, as a stream, all that come. A
    stream that is started again goes on behind its checkpoint, however long it was away.
    """

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return "universe string, id long, type string, data string, at string"

    def streamReader(self, schema) -> AppendLogStream:  # noqa: N802
        return AppendLogStream(self.options)

    def reader(self, schema) -> AppendLogTable:
        return AppendLogTable(self.options)


class _Log:
    def __init__(self, options: dict):
        self.path, self.universe = options["path"], options["universe"]
        self.since, self.backlog = int(options.get("since") or 0), int(options.get("backlog") or BACKLOG)

    def first(self) -> int:
        """The id behind which a new reader starts."""
        return max(self.since, last_id(Folder(self.path), self.universe) - self.backlog, 0)

    def files(self, start: int, end: int) -> list[LogFile]:
        """The files with ids above start, up to end."""
        names = Folder(self.path).names(self.universe)
        begins = [int(n.split(".")[0]) for n in names]
        return [LogFile(n, start, end) for n, b, after in zip(names, begins, [*begins[1:], end + 1], strict=False) if b <= end and after > start + 1]

    def events(self, file: LogFile) -> Iterator[tuple]:
        for e in _lines(Folder(self.path), self.universe, file.name):
            if file.start < e["id"] <= file.end:
                yield self.universe, e["id"], e["type"], e["data"], e["at"]


class AppendLogStream(_Log, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.first()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"id": max(last_id(Folder(self.path), self.universe), self.since)}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        return self.files(start["id"], end["id"])

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return self.events(partition)


class AppendLogTable(_Log, DataSourceReader):
    def partitions(self) -> list[LogFile]:
        return self.files(self.first(), last_id(Folder(self.path), self.universe)) or [LogFile("", 0, 0)]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return self.events(partition) if partition.name else iter(())


# ---- the wiki: lists of titles, each naming the next by a token, and a file a page


@dataclass
class TitleList(InputPartition):
    token: str


class WikiPages(DataSource):
    """The pages of a wiki: title, url, wikitext, updated_at. A title whose page is gone has nothing else.

    Under path, lists/first.json and lists/<token>.json hold {"titles": [...], "continue": token of the next list or absent}, and pages/<quoted title>.json
    {"title", "url", "wikitext", "updated_at"}. A task reads a list's pages. As a stream, lists are read once each, at most ``lists`` (option) a batch, and one that
    gets a token later goes on.
    """

    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return "title string, url string, wikitext string, updated_at string"

    def streamReader(self, schema) -> WikiStream:  # noqa: N802
        return WikiStream(self.options)

    def reader(self, schema) -> WikiTable:
        return WikiTable(self.options)


class _Wiki:
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("lists") or 1 << 62)

    def tokens(self, after: str, most: int | None = None) -> Iterator[str]:
        """The lists behind one ('': from the first on), by their tokens."""
        folder, n = Folder(self.path), 0
        while most is None or n < most:
            follows = "first" if not after else json.loads(folder.read("lists", f"{quote(after, safe='')}.json") or b"{}").get("continue")
            if not follows or folder.files.get_file_info(folder.at("lists", f"{quote(follows, safe='')}.json")).type == fs.FileType.NotFound:
                return
            yield follows
            after, n = follows, n + 1

    def pages(self, token: str) -> Iterator[tuple]:
        folder = Folder(self.path)
        for title in json.loads(folder.read("lists", f"{quote(token, safe='')}.json"))["titles"]:
            page = folder.read("pages", f"{quote(title, safe='')}.json")
            found = json.loads(page) if page else {}
            yield title, found.get("url"), found.get("wikitext"), found.get("updated_at")


class WikiStream(_Wiki, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.seen = ""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        for self.seen in self.tokens(self.seen, self.most):
            pass
        return {"after": self.seen}

    def partitions(self, start: dict, end: dict) -> list[TitleList]:
        out = []
        for token in self.tokens(start["after"]):
            out.append(TitleList(token))
            if token == end["after"]:
                break
        self.seen = end["after"]
        return out if start != end else []

    def read(self, partition: TitleList) -> Iterator[tuple]:
        return self.pages(partition.token)


class WikiTable(_Wiki, DataSourceReader):
    def partitions(self) -> list[TitleList]:
        return [TitleList(t) for t in self.tokens("")] or [TitleList("")]

    def read(self, partition: TitleList) -> Iterator[tuple]:
        return self.pages(partition.token) if partition.token else iter(())
