"""Table functions: a document's lines in, any number of proposals out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


@F.udtf(returnType="doc string, nth int, subject string, statement string")
class Proposals:
    """Statements about subjects, from the lines of one document in order: rows (doc, at, line) of a partition by doc.

    A heading (a line that begins with #) is the subject of the lines under it; every other line that is not blank is a statement, each once for a subject. A
    document without statements proposes one, which is null.
    """

    def __init__(self) -> None:
        self.doc, self.subject, self.said, self.n = None, None, set(), 0

    def eval(self, row: Row) -> Iterator[tuple]:
        self.doc, line = row["doc"], (row["line"] or "").strip()
        if line.startswith("#"):
            self.subject = line.lstrip("#").strip()
        elif line and (self.subject, line) not in self.said:
            self.said.add((self.subject, line))
            self.n += 1
            yield self.doc, self.n, self.subject, line

    def terminate(self) -> Iterator[tuple]:
        if not self.n:
            yield self.doc, 1, self.subject, None


def proposed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """doc, nth, subject, statement: the proposals of each document. key tells documents apart; a null text has one empty line."""
    lines = documents.select(F.col(key).cast("string").alias("doc"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line"))
    return Proposals(lines.asTable().partitionBy("doc").orderBy("at"))
