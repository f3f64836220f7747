"""Catalogue text files as records and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import code_key
from ..plans.pricing import DEFAULT_DECIMALS
from ..session import Cut

SCHEMA = "file string, record_no bigint, line_no int, kind string, fields array<string>"
_BEGIN = re.compile(r"~[A-Z]\|")


def decoded(data: bytes) -> str:
    """Text of a catalogue file: UTF-8 if it is that (a mark is dropped), else cp1252 with its
    undefined bytes as they are; line ends become ``\\n``."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        table = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]
        text = data.decode("latin-1").translate(dict(enumerate(table)))
    return text.replace("\r\n", "\n").replace("\r", "\n")


def records(text: str) -> Iterator[tuple[int, str, list[str]]]:
    """``(line, kind, fields)``: a record begins at a line like ``~C|`` and runs to the next.

    Family records have two fields, code and body (one closing bar dropped); others are
    split at bars, one empty field at the end dropped.  Lines before the first are ignored.
    """
    lines = text.split("\n")
    begins = [i for i, line in enumerate(lines) if _BEGIN.match(line)]
    for first, until in zip(begins, [*begins[1:], len(lines)]):
        raw = "\n".join(lines[first:until]).rstrip()
        kind, payload = raw[1], raw[3:]
        if kind == "P":
            code, _, body = payload.partition("|")
            yield first + 1, kind, [code.strip(), body.removesuffix("|")]
        else:
            fields = payload.split("|")
            yield first + 1, kind, fields[:-1] if fields[-1] == "" else fields


def split_files(files: DataFrame) -> DataFrame:
    """The records of files given as ``path, content`` (batch or stream), in batches of 10,000."""
    kind = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string()), ("fields", pa.list_(pa.string()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [{"file": name, "record_no": n, "line_no": line, "kind": k, "fields": f} for n, (line, k, f) in enumerate(records(decoded(data)))]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=kind)

    return files.select("path", "content").mapInArrow(split, SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files at a path on any file system, read once; raises ValueError if
    there are none."""
    found = Cut(split_files(spark.read.format("binaryFile").load(path)), n=F.count(F.lit(1)))
    if not found.counts["n"]:
        raise ValueError(f"no records in {path}")
    return found.rows


class CatalogSource(DataSource):
    """``spark.read.format("price_catalog").load(path)`` for files every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "price_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        names = glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path)
        return [InputPartition(n) for n in sorted(names)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            text = decoded(f.read())
        for n, (line, kind, fields) in enumerate(records(text)):
            yield partition.value, n, line, kind, fields


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(CatalogSource)


def _field(i: int) -> Column:
    return F.coalesce(F.get("fields", F.lit(i)), F.lit(""))


def exact_number(text: Column, default: Column) -> Column:
    """A decimal with comma or point; blank gives the default, anything else is an error."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit("."))
    value = plain.try_cast("decimal(18,6)")
    return F.when(plain == "", default).when(value.isNull(), F.raise_error(F.concat(F.lit("bad number "), text)).cast("decimal(18,6)")).otherwise(value)


class Catalog:
    """The tables of a catalogue; later records replace earlier ones of the same key, but the
    first chapter that lists a child is its parent."""

    def __init__(self, rows: DataFrame) -> None:
        self.records = rows
        self.spark = rows.sparkSession
        at = F.struct("file", "record_no")
        of = lambda kind: rows.filter(F.col("kind") == kind)
        first = lambda i: F.split(_field(i), r"\\")[0]

        codes = of("C").select(at.alias("at"), F.posexplode(F.split(_field(0), r"\\")).alias("pos", "code"), F.trim(_field(1)).alias("unit"), F.trim(_field(2)).alias("summary"), exact_number(first(3), F.lit(None).cast("decimal(18,6)")).alias("price"), F.trim(first(4)).alias("date"), F.trim(_field(5)).alias("type"))
        codes = codes.filter(F.trim("code") != "").withColumn("code", F.trim("code"))
        self.concepts = codes.groupBy(code_key(F.col("code")).alias("code_key")).agg(F.max_by(F.struct("code", "unit", "summary", "price", "date", "type"), F.struct("at", "pos")).alias("c")).select("code_key", "c.*")

        parts = F.split(_field(1), r"\\")
        one = F.lit(1).cast("decimal(18,6)")
        listed = of("D").select(at.alias("at"), F.trim(_field(0)).alias("parent"), parts.alias("p")).withColumn("parent_key", code_key(F.col("parent")))
        triples = listed.select("at", "parent", "parent_key", F.posexplode(F.expr("CASE WHEN size(p) >= 3 THEN transform(sequence(0, (size(p) - 3) div 3), i -> struct(trim(p[i * 3]) AS child, p[i * 3 + 1] AS f, p[i * 3 + 2] AS y)) ELSE array() END")).alias("ord", "t")).filter("t.child <> ''")
        last = listed.groupBy("parent_key").agg(F.max("at").alias("at"))
        self.decompositions = triples.join(last, ["parent_key", "at"]).select("parent_key", "parent", "ord", F.col("t.child").alias("child"), exact_number(F.col("t.f"), one).alias("factor"), exact_number(F.col("t.y"), one).alias("yield"))
        self.parents = triples.filter(F.col("parent").endswith("#")).groupBy(code_key(F.col("t.child")).alias("child_key")).agg(F.min_by("parent", F.struct("at", "ord")).alias("parent"))

        self.texts = of("T").groupBy(code_key(_field(0)).alias("code_key")).agg(F.max_by(_field(1), at).alias("text"))
        self.families_raw = of("P").filter(_field(0) != "").groupBy(_field(0).alias("code")).agg(F.max_by(_field(1), at).alias("body"))

    def version(self) -> str | None:
        """Field 1 of the last version record."""
        row = self.records.filter("kind = 'V'").orderBy(F.desc("file"), F.desc("record_no")).select(_field(1)).first()
        return row[0] if row else None

    def decimals(self) -> dict[str, int]:
        """The roundings of the last coefficients record; what is no whole number keeps its default."""
        row = self.records.filter("kind = 'K'").orderBy(F.desc("file"), F.desc("record_no")).select(F.split(_field(0), r"\\")).first()
        out = dict(DEFAULT_DECIMALS)
        for name, value in zip(out, row[0] if row else ()):
            if re.fullmatch(r"\s*[-+]?\d+\s*", value):
                out[name] = abs(int(value))
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(read_records(spark, path))

    @classmethod
    def from_text(cls, spark: SparkSession, text: str) -> Catalog:
        """The catalogue of a text at hand."""
        rows = [("", n, line, kind, fields) for n, (line, kind, fields) in enumerate(records(text))]
        if not rows:
            raise ValueError("no records in the text")
        return cls(spark.createDataFrame(rows, SCHEMA))
