"""SQLite tables as a Spark data source, split by row number."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .errors import SQLiteTableError

#: Row numbers of one partition at least, and partitions at most: row numbers may lie far apart.
ROWS, PARTITIONS = 100_000, 10_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro", uri=True)


def list_tables(path: str | Path) -> list[str]:
    """Tables of the user, by name."""
    try:
        with _open(str(path)) as con:
            return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    except sqlite3.DatabaseError as e:
        raise SQLiteTableError(f"Could not read {path}: {e}") from e


def chosen(path: str | Path, table: str | None) -> str:
    found = list_tables(path)
    if not found:
        raise SQLiteTableError(f"No tables found in SQLite file {path}.")
    if table is not None and table not in found:
        raise SQLiteTableError(f"Table {table!r} not found in {path}. Available: {', '.join(found)}.")
    return table or found[0]


def kind(declared: str) -> T.DataType:
    """By SQLite's rules of affinity."""
    name = declared.upper()
    rules = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))
    return next((k for part, k in rules if part in name), T.DoubleType() if name.startswith(("NUM", "DEC")) else T.StringType())


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.schema = path, table, schema

    def partitions(self) -> list[InputPartition]:
        """Ranges of row numbers; a view, or a table without them, is one."""
        with _open(self.path) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [InputPartition(None)]
        if low is None:
            return [InputPartition(None)]
        step = max(ROWS, -(-(high - low + 1) // PARTITIONS))
        return [InputPartition((at, min(at + step - 1, high))) for at in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where, of = ("", ()) if partition.value is None else (" WHERE rowid BETWEEN ? AND ?", partition.value)
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        convert = [CONVERT.get(type(f.dataType), lambda v: v) for f in self.schema.fields]
        with _open(self.path) as con:
            for row in con.execute(f"SELECT {columns} FROM {quoted(self.table)}{where}", of):
                yield tuple(None if v is None else c(v) for c, v in zip(convert, row, strict=True))


#: SQLite lets any value stand in any column.
CONVERT = {
    T.LongType: lambda v: int(v) if isinstance(v, int) or str(v).lstrip("-").isdigit() else None,
    T.DoubleType: lambda v: float(v) if isinstance(v, int | float) else None,
    T.StringType: lambda v: v.decode(errors="replace") if isinstance(v, bytes) else str(v),
    T.BinaryType: lambda v: v if isinstance(v, bytes) else str(v).encode(),
}


class SQLite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prismetric_sqlite"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as con:
            rows = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        return T.StructType([T.StructField(r[1], kind(r[2] or "")) for r in rows])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], self.options["table"], schema)


def read(spark: SparkSession, path: str | Path, table: str | None = None) -> DataFrame:
    """The table, or the first by name. The file must be where all executors see it."""
    name = chosen(path, table)
    spark.dataSource.register(SQLite)
    return spark.read.format(SQLite.name()).option("path", str(path)).option("table", name).load()
