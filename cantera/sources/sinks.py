"""Writers of items, chapters, documents and reports."""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(lines: DataFrame, path: str) -> None:
    """JSON text (column ``value``) as line files, one per task."""
    lines.select("value").write.mode("overwrite").text(path)


def print_json_lines(lines: DataFrame, out: TextIO) -> int:
    """Lines one after another to a stream at the edge; returns their number."""
    n = 0
    for row in lines.select("value").toLocalIterator(prefetchPartitions=True):
        out.write(row[0] + "\n")
        n += 1
    return n


def print_json_array(lines: DataFrame, out: TextIO) -> int:
    """A JSON array to a stream at the edge; returns the number of elements."""
    n = 0
    out.write("[")
    for row in lines.select("value").toLocalIterator(prefetchPartitions=True):
        out.write((",\n" if n else "\n") + row[0])
        n += 1
    out.write("\n]\n")
    return n


def write_chapters(rows: DataFrame, path: str, chapter: str = "chapter_name") -> None:
    """One folder of JSON files per chapter."""
    rows.write.mode("overwrite").partitionBy(chapter).json(path)


def write_documents(rows: DataFrame, path: str, prefix: str | None = None, key: str = "item_key") -> None:
    """Documents as parquet, only those whose key begins with ``prefix`` if given."""
    kept = rows if prefix is None else rows.filter(F.col(key).startswith(prefix))
    kept.write.mode("overwrite").parquet(path)


def write_duplicate_reports(summary: DataFrame, groups: DataFrame, flags: DataFrame, path: str) -> None:
    """The three duplicate reports as JSON under one folder."""
    for name, rows in (("summary", summary), ("groups", groups), ("either", flags)):
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
