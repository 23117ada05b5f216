"""Zip archives and their entries as tables: limits, paths, listings, decoding, and what kind of source an archive is."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .live import Folder

MIB = 1 << 20
#: Limits that an archive keeps before anything is inflated: its own bytes, entries, bytes of an entry, bytes of all entries.
ARCHIVE_BYTES, ENTRIES, ENTRY_BYTES, TOTAL_BYTES = 200 * MIB, 10_000, 200 * MIB, 500 * MIB
#: Bytes of a text entry that are decoded.
TEXT_BYTES = 2 * MIB


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content of the files at a path, in folders of any depth."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def entry_path(name: Column) -> Column:
    """The entry's path with slashes and without '.' segments; null where a name is empty, absolute, names a drive, holds NUL or leaves the archive."""
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = (name == "") | F.contains(name, F.lit("\0")) | slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


ENTRY_COLUMNS = "archive string, archive_sha256 string, path string, content binary, error string"
#: Bytes of entries that are handed on at once, and of an archive that are hashed at once.
BATCH_BYTES, CHUNK_BYTES = 4 * MIB, MIB


def normal_path(name: str) -> str | None:
    """entry_path for one name."""
    if not name or "\0" in name or name[0] in "/\\" or (name[0].isascii() and name[0].isalpha() and name[1:2] == ":"):
        return None
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    return "/".join(parts) if parts and ".." not in parts else None


def _contents(file: IO[bytes], size: int) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(path, content, error) of the entries of an archive, one at a time: its directory is read first, at the end of the file, and then each entry where it is."""
    if size > ARCHIVE_BYTES:
        yield None, None, "archive too large"
        return
    try:
        archive = zipfile.ZipFile(file)
    except (ValueError, OSError, zipfile.BadZipFile):
        yield None, None, "bad archive"
        return
    infos = archive.infolist()
    if len(infos) > ENTRIES or any(i.file_size > ENTRY_BYTES for i in infos) or sum(i.file_size for i in infos) > TOTAL_BYTES:
        yield None, None, "archive over its limits"
        return
    paths = [None if i.is_dir() else normal_path(i.orig_filename) for i in infos]
    last = {p: n for n, p in enumerate(paths)}
    for n, (info, path) in enumerate(zip(infos, paths, strict=True)):
        if info.is_dir() or (path is not None and last[path] != n):
            continue
        if path is None:
            yield None, None, "path not allowed"
        elif info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            yield path, None, "compression not supported"
        else:
            try:
                yield path, archive.read(info), None
            except (zipfile.BadZipFile, zlib.error, RuntimeError, ValueError, OSError, EOFError):
                yield path, None, "bad entry"


def rolling_sha256(file: IO[bytes]) -> str:
    """The digest of a file from its beginning, some of it in memory at a time; the file is at its beginning again."""
    state = hashlib.sha256()
    while chunk := file.read(CHUNK_BYTES):
        state.update(chunk)
    file.seek(0)
    return state.hexdigest()


def _batches(archive: str, file: IO[bytes], size: int) -> Iterator[pa.RecordBatch]:
    digest, held, n = rolling_sha256(file), [], 0
    for entry in _contents(file, size):
        held.append(entry)
        n += len(entry[1] or b"")
        if n >= BATCH_BYTES:
            yield _entry_batch(archive, digest, held)
            held, n = [], 0
    if held:
        yield _entry_batch(archive, digest, held)


def _entry_batch(archive: str, digest: str, rows: list[tuple]) -> pa.RecordBatch:
    path, content, error = zip(*rows, strict=True)
    columns = [pa.array([archive] * len(rows)), pa.array([digest] * len(rows)), pa.array(path, pa.string()), pa.array(content, pa.binary()), pa.array(error, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["archive", "archive_sha256", "path", "content", "error"])


def entries(archives: DataFrame) -> DataFrame:
    """archive, archive_sha256, path, content, sha256, error of the file entries of each archive (path, content), for archives that are columns of a table.

    Declared sizes are checked before anything is inflated. An archive that breaks a limit or cannot be read is one row with an error, and so is
    an entry whose name is not allowed or whose content cannot be inflated. Of entries with one path the last is kept. Rows come to Python a few at a time, whole; archives
    in files are better read by ``archive_entries``.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                data = content.as_buffer() or b""
                yield from _batches(path.as_py(), pa.BufferReader(data), len(data))

    small = archives.select("path", "content")
    return small.mapInArrow(opened, ENTRY_COLUMNS).select("archive", "archive_sha256", "path", "content", F.sha2("content", 256).alias("sha256"), "error")


@dataclass
class ArchiveFile(InputPartition):
    path: str
    size: int


class ZipArchives(DataSource):
    """ENTRY_COLUMNS of the zip files under a folder (option path, a URI that driver and executors reach), a task for each file, which reads what it needs of it and holds some entries at a time."""

    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def schema(self) -> str:
        return ENTRY_COLUMNS

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"])


class ZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ArchiveFile]:
        folder = Folder(self.path)
        found = folder.files.get_file_info(fs.FileSelector(folder.root, recursive=True, allow_not_found=True))
        return [ArchiveFile(f.path, f.size) for f in found if f.is_file and f.base_name.lower().endswith(".zip")] or [ArchiveFile("", 0)]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.path)
        if partition.path:
            with folder.files.open_input_file(partition.path) as file:
                yield from _batches(partition.path[len(folder.root) :].lstrip("/"), file, partition.size)


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """entries of the zip files under a folder; archive is a file's path below it."""
    spark.dataSource.register(ZipArchives)
    return spark.read.format("zip_archives").option("path", path).load().select("archive", "archive_sha256", "path", "content", F.sha2("content", 256).alias("sha256"), "error")


def listing(paths: DataFrame, prefix: str, path: str = "path", size: str = "size") -> DataFrame:
    """path, kind, size: the immediate children of a prefix ('' for the root): files with their size, each folder once, in order of path."""
    lead = f"{prefix.rstrip('/')}/" if prefix else ""
    inside = paths.where(F.col(path).startswith(lead) & (F.col(path) != lead)).withColumn("_rest", F.substring(path, len(lead) + 1, 1 << 30))
    child = F.concat(F.lit(lead), F.substring_index("_rest", "/", 1))
    folder = F.contains(F.col("_rest"), F.lit("/"))
    grouped = inside.groupBy(child.alias("path")).agg(F.bool_or(folder).alias("_folder"), F.max(F.when(~folder, F.col(size))).alias("size"))
    return grouped.select("path", F.when(F.col("_folder"), "directory").otherwise("file").alias("kind"), F.when(~F.col("_folder"), F.col("size")).alias("size")).orderBy("path")


def decoded(content: Column, most: int = TEXT_BYTES) -> Column:
    """(text, truncated): bytes as text by their byte order mark, UTF-8 without one; cut at so many bytes, damaged sequences replaced."""
    return F.pandas_udf(_decoded, "text string, truncated boolean")(F.substring(content, 1, most), F.octet_length(content) > most)


def _decoded(content: pd.Series, truncated: pd.Series) -> pd.DataFrame:
    marks = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for mark, code in marks:
            if data.startswith(mark):
                return data[len(mark) :].decode(code, "replace")
        return data.decode("utf-8", "replace")

    return pd.DataFrame({"text": content.map(one), "truncated": truncated})


def reads_as_text(text: Column, sample: int = 8000, most: float = 0.1) -> Column:
    """Whether a decoded text is one: not blank, no NUL and at most a tenth of replacement characters in its first characters."""
    head = F.substring(text, 1, sample)
    replaced = F.length(head) - F.length(F.replace(head, F.lit("�"), F.lit("")))
    return (F.trim(text) != "") & ~F.contains(head, F.lit("\0")) & (replaced / F.length(head) <= most)


def source_types(paths: DataFrame, archive: str = "archive", path: str = "path", record_shaped: str | None = None) -> DataFrame:
    """archive, kind, confident, n: what each archive's paths look like, by the first rule that fits.

    The rules in order: a marker folder; JSON files of records (record_shaped: a boolean column of the path's content); folders json and html
    side by side; a page with a folder of attachments; markdown alone; one PDF; one DOCX; anything. n counts what the rule is about.
    """
    low = F.lower(path)
    rows = paths.where(~F.col(path).startswith("__MACOSX/")).select(archive, path, low.alias("_low"), (F.col(record_shaped) if record_shaped else F.lit(False)).alias("_records"))
    stem = F.when(F.col("_low").rlike(r"\.html?$"), F.regexp_replace(path, r"(?i)\.html?$", ""))
    attached = F.regexp_extract(path, "^(.*)_files/", 1)
    pages = rows.where(stem.isNotNull()).select(archive, stem.alias("_stem")).distinct()
    folders = rows.where(attached != "").select(archive, attached.alias("_stem")).distinct()
    with_files = pages.join(folders, [archive, "_stem"]).groupBy(archive).agg(F.lit(True).alias("_attached"))
    many = lambda c: F.count_if(c)
    facts = rows.groupBy(archive).agg(
        F.count("*").alias("_all"),
        F.bool_or(F.array_contains(F.split("_low", "/"), ".obsidian")).alias("_marker"),
        F.coalesce(F.bool_or(F.col("_low").endswith(".json") & F.col("_records")), F.lit(False)).alias("_record_files"),
        F.bool_or(F.col("_low").startswith("json/")).alias("_json"),
        F.bool_or(F.col("_low").startswith("html/")).alias("_html"),
        many(F.col("_low").endswith(".md")).alias("_md"),
        many(F.col("_low").endswith(".json")).alias("_jsons"),
        many(F.col("_low").rlike(r"\.html?$")).alias("_pages"),
        many(F.col("_low").endswith(".pdf")).alias("_pdf"),
        many(F.col("_low").endswith(".docx")).alias("_docx"),
    )
    met = facts.join(with_files, archive, "left")
    one = F.col("_all") == 1
    rules = [
        (F.col("_marker"), "obsidian", True, F.col("_md")),
        (F.col("_record_files"), "kanka", True, F.col("_jsons")),
        (F.col("_json") & F.col("_html"), "world-anvil", True, F.col("_all")),
        (F.coalesce("_attached", F.lit(False)), "onenote", True, F.col("_pages")),
        (F.col("_md") == F.col("_all"), "obsidian", False, F.col("_md")),
        (one & (F.col("_pdf") == 1), "pdf", True, F.col("_all")),
        (one & (F.col("_docx") == 1), "docx", True, F.col("_all")),
    ]
    kind, sure, n = F.lit("generic"), F.lit(False), F.col("_all")
    for rule, name, confident, count in reversed(rules):
        kind, sure, n = F.when(rule, name).otherwise(kind), F.when(rule, confident).otherwise(sure), F.when(rule, count).otherwise(n)
    return met.select(archive, kind.alias("kind"), sure.alias("confident"), n.alias("n"))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> str | None:
    """The text of a DOCX file: headings with #, list items with '- ', tables as rows between bars, an empty line between blocks; null where it cannot be read."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    signs = {f"{W}br": "\n", f"{W}tab": "\t"}
    said = lambda node: " ".join("".join(signs.get(t.tag) or (t.tag == f"{W}t" and t.text) or "" for t in node.iter()).split())
    blocks: list[tuple[str, str]] = []
    for node in body if body is not None else []:
        if node.tag == f"{W}tbl":
            rows = [[said(cell) for cell in row.findall(f"{W}tc")] for row in node.iter(f"{W}tr")]
            blocks.append(("table", "\n".join(f"| {' | '.join(r)} |" for r in rows if r)))
        elif node.tag == f"{W}p" and said(node):
            style = next((s.get(f"{W}val", "") for s in node.iter(f"{W}pStyle")), "")
            if style.lower().startswith("heading") and style[7:].strip().isdigit():
                blocks.append(("heading", f"{'#' * min(6, int(style[7:]))} {said(node)}"))
            elif node.find(f"{W}pPr/{W}numPr") is not None:
                kind, text = ("list", f"- {said(node)}")
                blocks[-1:] = [(kind, f"{blocks[-1][1]}\n{text}")] if blocks and blocks[-1][0] == kind else [*blocks[-1:], (kind, text)]
            else:
                blocks.append(("text", said(node)))
    return "".join(f"{text}\n\n" for _, text in blocks if text)[:-1]


def docx_text(content: Column) -> Column:
    """docx_blocks of a column of files."""

    def read(files: pd.Series) -> pd.Series:
        return files.map(lambda c: None if c is None else docx_blocks(c))

    return F.pandas_udf(read, "string")(content)


def page_text(items: DataFrame, document: str = "document") -> DataFrame:
    """document, text of positioned text items (document, page, nth, text, x, y, width, size, line_end): a blank where a gap on a line is wider than 0.15 of the size; pages under '--- page N ---'.

    Reading the items out of a PDF is left to a reader; this joins what it gives.
    """
    in_order = Window.partitionBy(document, "page").orderBy("nth")
    lag = lambda c: F.lag(c).over(in_order)
    gap = F.col("x") - (lag("x") + lag("width"))
    wide = (F.abs(F.col("y") - lag("y")) < 0.5) & (F.length("text") > 0) & (gap > 0.15 * F.col("size")) & ~F.coalesce(lag("line_end"), F.lit(False)) & ~lag("text").endswith(" ") & ~F.col("text").startswith(" ")
    piece = F.concat(F.when(wide, " ").otherwise(""), "text", F.when(F.col("line_end"), "\n").otherwise(""))
    pages = items.withColumn("_piece", piece).groupBy(document, "page").agg(F.array_sort(F.collect_list(F.struct("nth", "_piece"))).alias("p"))  # the items of one page
    text = F.regexp_replace(F.array_join("p._piece", ""), r"\n+$", "")
    shown = pages.select(document, "page", F.concat(F.lit("--- page "), F.col("page").cast("string"), F.lit(" ---\n\n"), text).alias("_text"))
    return shown.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("page", "_text"))).alias("p")).select(document, F.array_join("p._text", "\n\n").alias("text"))


# Named entities.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def entities_decoded(text: Column) -> Column:
    """Named, decimal and hexadecimal entities as characters; unknown ones stay."""
    return F.pandas_udf(_entities, "string")(text)


def _entities(text: pd.Series) -> pd.Series:
    import re

    def sign(m: re.Match) -> str:
        body = m[1]
        if not body.startswith("#"):
            return NAMED.get(body, m[0])
        try:
            return chr(int(body[2:], 16)) if body[1] in "xX" else chr(int(body[1:]))
        except (ValueError, OverflowError):
            return m[0]

    return text.map(lambda t: None if t is None else re.sub(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+);", sign, t))
