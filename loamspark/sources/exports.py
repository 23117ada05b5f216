"""A folder of markdown files, one an entry, that is there as a whole or not at all."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import connectors
from .live import Folder


@dataclass
class Written(WriterCommitMessage):
    n: int


class MarkdownExport(DataSource):
    """A sink for rows (slug, text): path/<slug>.md with the text as it is, and path/README.md with the number of files.

    Tasks write into a folder beside path, which gets path's name when all of them are done and the README is there: a rename. Where a task fails for
    good, or two rows have one slug, that folder goes and path is as before; no task makes it, so those still running then write nothing more. A task that is run again writes the same files again. Options: path (a URI that driver
    and executors reach), name and date for the README. Mode append needs a path that is not there, overwrite replaces it.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown_export"

    def schema(self) -> str:
        return "slug string, text string"

    def writer(self, schema, overwrite: bool) -> MarkdownWriter:
        return MarkdownWriter(self.options, overwrite)


class MarkdownWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.options, self.overwrite = options["path"].rstrip("/"), dict(options), overwrite
        self.staging = f"{self.path}.{uuid.uuid4().hex}"
        if not overwrite and self._there():
            raise ValueError(f"{self.path} is there already")
        folder = Folder(self.staging)
        folder.files.create_dir(folder.root, recursive=True)

    def _there(self) -> bool:
        folder = Folder(self.path)
        return folder.files.get_file_info(folder.root).type != fs.FileType.NotFound

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, n = Folder(self.staging), 0
        for row in iterator:
            slug, text = row["slug"], row["text"]
            if not slug or "/" in slug or slug.startswith(".") or slug == "README":
                raise ValueError(f"{slug!r} is no name of a file")
            folder.put((text or "").encode(), f"{slug}.md")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        n, folder = sum(m.n for m in messages if m), Folder(self.staging)
        files = len(folder.names())
        if files != n:
            self.abort(messages)
            raise ValueError(f"{n} rows have {files} slugs")
        title = f"# {self.options.get('name', 'Export')}"
        day = f", {self.options['date']}" if "date" in self.options else ""
        folder.put(f"{title}\n\nEntries: {n}{day}. Each is a file named after its slug: a front of JSON values, an empty line, and its text.\n".encode(), "README.md")
        if self.overwrite and self._there():
            folder.files.delete_dir(Folder(self.path).root)
        folder.files.move(folder.root, Folder(self.path).root)

    def abort(self, messages: list[Written | None]) -> None:
        folder = Folder(self.staging)
        if folder.files.get_file_info(folder.root).type != fs.FileType.NotFound:
            gone = f"{folder.root}.gone"  # renamed first: tasks that still run cannot add to it while it is deleted
            folder.files.move(folder.root, gone)
            for left in reversed(range(20)):
                try:
                    return folder.files.delete_dir(gone)
                except OSError:  # a file that was being opened during the rename came in: one a task at most
                    if not left:
                        raise
                    time.sleep(0.05)


def export(entries: DataFrame, path: str, name: str = "Export", date: str | None = None, mode: str = "append") -> None:
    """Write entries (connectors.FRONT and body) as a folder of markdown files with a README."""
    spark = entries.sparkSession
    spark.dataSource.register(MarkdownExport)
    options = {"path": path, "name": name} | ({"date": date} if date else {})
    connectors.entry_markdown(entries).write.format("markdown_export").options(**options).mode(mode).save()


def exported(spark: SparkSession, path: str) -> DataFrame:
    """An export read back: file, FRONT, body and error of each entry."""
    files = spark.read.text(f"{path}/*.md", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))
    return connectors.parsed_markdown(files.where("file <> 'README.md'")).drop("text")
