"""Formats that Spark has no reader for: SQLite tables as a data source, and multi-row parsers as table functions for SQL.

``register`` makes both known to a session. A table function streams its rows, so a document's words or parts are never one array.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from quillgraph.sources import markup, works

_NAME = re.compile(r"\w+")


class _Range(InputPartition):
    def __init__(self, k: int, n: int):
        super().__init__((k, n))
        self.k, self.n = k, n


class SqliteReader(DataSourceReader):
    """Reads ranges of row ids: each task asks the table for its last one itself, so the driver opens nothing."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.table, self.columns = options["path"], options["dbtable"], schema.fieldNames()
        self.n = int(options.get("numPartitions", 4))
        if self.n < 1 or not all(_NAME.fullmatch(x) for x in [self.table, *self.columns]):
            raise ValueError("names of letters, digits and underscores, and one partition or more")

    def partitions(self) -> list[InputPartition]:
        return [_Range(k, self.n) for k in range(self.n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        db = opened(self.path)
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            if high is None:
                return
            size = high - low + 1
            begin, end = (low + size * k // partition.n for k in (partition.k, partition.k + 1))
            yield from db.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (begin, end))
        finally:
            db.close()


def opened(path: str) -> sqlite3.Connection:
    """A database opened for reading: in place where the path is a local file, else from its bytes."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return sqlite3.connect(f"file:{quote(unquote(at.path) if at.scheme else path)}?mode=ro", uri=True)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    db = sqlite3.connect(":memory:")
    with system.open_input_stream(name) as f:
        db.deserialize(f.read())
    return db


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").schema(...).option("dbtable", T).load(path)``; the schema's columns are read."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


@udtf(returnType="verse string, pos int, id string, lemma string, morph string, surface string, kind string")
class OsisWords:
    """Words of an OSIS document: ``SELECT w.* FROM books, LATERAL osis_words(xml) w``."""

    def eval(self, xml: str):
        for w in markup.osis_rows(xml) if xml is not None else ():
            yield w["verse"], w["pos"], w["id"], w["lemma"], w["morph"], w["surface"], w["kind"]


@udtf(returnType="chapter int, number int, title string, text string")
class WorkParts:
    """Parts of a confessional work's page by the work's rule: ``LATERAL work_parts(html, 'belgic')``."""

    def eval(self, html: str, work: str):
        if work not in works.RULES:
            raise ValueError(f"no rule for {work}")
        for p in works.cut(works.blocks(html), works.RULES[work]) if html is not None else ():
            yield p["chapter"], p["number"], p["title"], p["text"]


@udtf(returnType="file string, node long, value string")
class FeatureNodes:
    """Node values of feature lines: ``tf_nodes(TABLE(lines) PARTITION BY file ORDER BY line_no)``, blank lines counted.

    For small files; a large one is better read by ``textfabric.node_feature``, which cuts it in splits.
    """

    def __init__(self):
        self.node = 0

    def eval(self, row):
        line = row["line"]
        spec = re.match(r"(\d+)(?:-(\d+))?\t", line)
        if spec:
            low, self.node = int(spec[1]), int(spec[2] or spec[1])
            for n in range(low, max(low, self.node) + 1):
                yield row["file"], n, line.rpartition("\t")[2]
        else:
            self.node += 1
            if line.strip(" "):
                yield row["file"], self.node, line


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    for name, f in (("osis_words", OsisWords), ("work_parts", WorkParts), ("tf_nodes", FeatureNodes)):
        spark.udtf.register(name, f)


def sqlite_table(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Distinct rows of a table in a SQLite file, as text; read by tasks."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(", ".join(f"{c} string" for c in columns)).option("dbtable", table).load(path).distinct()
