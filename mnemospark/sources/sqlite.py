"""SQLite files as a source and a sink: many files in a shared folder, or one file that something else wrote.

`write` has each task fill a file of its own, `read` deals files out by ranges of rowid. Conditions on whole numbers and
strings that are given to `read` are answered by SQLite, from its indexes where there are any; only the columns of the given
schema are read. Conditions are given and not taken from the plan: Spark keeps what it pushed into a Python source with the
table, so two filters on one DataFrame would both get the rows of the last.

A folder's manifest names the files of finished tasks and replaces the one before in one step, so a reader sees all of a write or
nothing, and files of tasks that failed or ran twice are never read. One writer at a time; `sources/log.py` is the
store for several. All executors must see the path as a folder.

Columns that a file lacks are null. Booleans are stored as 0 and 1; NaN is stored as null, SQLite has no such value. Types
that SQLite has no place for are an error when written, as is a stored value that isn't of the schema's type when read.
"""

from __future__ import annotations

import json
import math
import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import chain
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ledger import FACTS
from ..operators.lifecycle import migrate

NAME = "sqlite_files"
MANIFEST = "manifest.json"
#: Bytes of a file for each task that reads it, and rows of one batch.
SPLIT_BYTES, BATCH = 64 << 20, 1000
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_KINDS = ((*_WHOLE, T.BooleanType), "INTEGER"), ((T.FloatType, T.DoubleType), "REAL"), ((T.StringType,), "TEXT"), ((T.BinaryType,), "BLOB")
_SIGNS = ("=", "!=", ">", ">=", "<", "<=", "in", "is null", "is not null")


def _kind(t: T.DataType) -> str:
    for types, kind in _KINDS:
        if isinstance(t, types):
            return kind
    raise TypeError(f"SQLite files have no {t.simpleString()} columns")


def _affinity(declared: str) -> str:
    """What SQLite makes of values by a column's declared type."""
    d = declared.upper()
    for parts, kind in ((("INT",), "INTEGER"), (("CHAR", "CLOB", "TEXT"), "TEXT"), (("BLOB",), "BLOB"), (("REAL", "FLOA", "DOUB"), "REAL")):
        if any(p in d for p in parts):
            return kind
    return "NUMERIC" if d else "BLOB"


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def local(path: str) -> str:
    """The path as files are opened by: plain or file:, nothing else."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"SQLite files are opened by path, not over {parts.scheme}:")
    return (parts.path if parts.scheme else path).rstrip("/")


def _open(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(file)}?mode=ro", uri=True)


def _manifest(path: str) -> dict:
    if os.path.isfile(path):
        return {"files": [path], "schema": None}
    where = f"{path}/{MANIFEST}"
    if os.path.exists(where):
        with open(where) as f:
            found = json.load(f)
        return {**found, "files": [f"{path}/{name}" for name in found["files"]]}
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    return {"files": sorted(f"{path}/{n}" for n in os.listdir(path) if n.endswith((".db", ".sqlite"))), "schema": None}


@dataclass
class Rows(ds.InputPartition):
    """A file's rows from one rowid to another; all of them where there are no rowids."""

    file: str
    low: int | None = None
    high: int | None = None

    def __post_init__(self):
        super().__init__((self.file, self.low, self.high))


class Reader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, local(options["path"]), options.get("table", "facts")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        for f in schema:
            _kind(f.dataType)
        self.tests = [self._test(*given) for given in json.loads(options.get("where", "[]"))]

    def _test(self, column: str, sign: str, value: int | str | list | None = None) -> tuple[str, str, list]:
        """(column, condition with {0} for it, values), which SQLite decides as Spark does."""
        if column not in self.schema.names or sign not in _SIGNS:
            raise ValueError(f"no condition {column} {sign}")
        if sign.startswith("is"):
            return column, f"{{0}} {sign}", []
        t, values = self.schema[column].dataType, value if sign == "in" else [value]
        fits = int if isinstance(t, _WHOLE) else str if isinstance(t, T.StringType) else None
        if fits is None or not all(v is None or type(v) is fits for v in values):
            raise ValueError(f"{column} {sign} takes whole numbers or strings, as the column is")
        by_bytes = " COLLATE BINARY" if fits is str else ""
        if sign == "in":  # a list of any length is one value, but for strings that end at a zero byte there
            cut = [v for v in values if fits is str and v and "\x00" in v]
            tests = [f"{{0}}{by_bytes} IN (SELECT value FROM json_each(?))", *[f"{{0}}{by_bytes} = ?"] * len(cut)]
            return column, f"({' OR '.join(tests)})", [json.dumps([v for v in values if v not in cut]), *cut]
        return column, f"{{0}}{by_bytes} {sign} ?", values

    def partitions(self) -> list[Rows]:
        out = []
        for file in _manifest(self.path)["files"]:
            parts = max(1, math.ceil(os.path.getsize(file) / self.split))
            if parts == 1:
                out.append(Rows(file))
                continue
            with closing(_open(file)) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
                except sqlite3.OperationalError:  # a view, or a table without rowids
                    low = high = None
            if low is None:
                out.append(Rows(file))
                continue
            cuts = sorted({low + (high - low + 1) * i // parts for i in range(parts)})
            out += [Rows(file, a, b - 1) for a, b in zip(cuts, [*cuts[1:], high + 1], strict=True)]
        return out or [Rows("")]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        types = [to_arrow_type(f.dataType) for f in self.schema]
        with closing(_open(partition.file)) as db:
            declared = {r[1]: _affinity(r[2] or "") for r in db.execute(f"PRAGMA table_info({_name(self.table)})")}
            if not declared:
                raise ValueError(f"{partition.file} has no table {self.table}")

            def stored(f: T.StructField) -> str:
                if f.name not in declared:
                    return "NULL"
                return _name(f.name) if declared[f.name] == _kind(f.dataType) else f"CAST({_name(f.name)} AS {_kind(f.dataType)})"

            tests = [condition.format(stored(self.schema[column])) for column, condition, _ in self.tests]
            values = [v for _, _, given in self.tests for v in given]
            if partition.low is not None:
                tests.append("rowid BETWEEN ? AND ?")
                values += [partition.low, partition.high]
            columns = ", ".join(map(stored, self.schema)) or "1"
            found = db.execute(f"SELECT {columns} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(tests)}" if tests else ""), values)
            while rows := found.fetchmany(BATCH):
                cells = [[None if v is None else bool(v) for v in c] if pa.types.is_boolean(t) else c for c, t in zip(zip(*rows, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cells, types, strict=True)], names=self.schema.names)


@dataclass
class Written(ds.WriterCommitMessage):
    file: str | None


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.table, self.overwrite = schema, local(options["path"]), options.get("table", "facts"), overwrite
        self.index = [c for c in options.get("index", "").split(",") if c]
        self.columns = ", ".join(f"{_name(f.name)} {_kind(f.dataType)}" for f in schema)
        if set(self.index) - set(schema.names):
            raise ValueError(f"no columns {sorted(set(self.index) - set(schema.names))} to index")
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file of its own for the task; none if it has no rows."""
        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return Written(None)
        name = f"part-{uuid.uuid4().hex}.db"
        with closing(sqlite3.connect(f"{self.path}/{name}", isolation_level=None)) as db:
            db.execute("PRAGMA journal_mode = OFF")  # a file that isn't finished is never read
            db.execute(f"CREATE TABLE {_name(self.table)} ({self.columns})")
            db.execute("BEGIN")
            put = f"INSERT INTO {_name(self.table)} VALUES ({', '.join('?' * len(self.schema))})"
            for batch in chain([first], batches):
                db.executemany(put, zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for column in self.index:
                db.execute(f"CREATE INDEX {_name('by_' + column)} ON {_name(self.table)} ({_name(column)})")
            db.execute("COMMIT")
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        where = f"{self.path}/{MANIFEST}"
        files = [m.file for m in messages if m and m.file]
        if not self.overwrite and os.path.exists(where):
            files = [os.path.basename(f) for f in _manifest(self.path)["files"]] + files
        temp = f"{where}.{uuid.uuid4().hex}"
        with open(temp, "w") as f:
            json.dump({"files": files, "schema": self.schema.json()}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, where)
        self._sweep(set(files))

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep({os.path.basename(f) for f in _manifest(self.path)["files"]} if os.path.exists(f"{self.path}/{MANIFEST}") else set())

    def _sweep(self, kept: set[str]) -> None:
        """Drops files that no reader will be told of."""
        for name in os.listdir(self.path):
            if name.startswith("part-") and name.removesuffix("-journal") not in kept:
                os.remove(f"{self.path}/{name}")


class Files(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        """What the folder was written with; of other files, what the first one declares."""
        found = _manifest(local(self.options["path"]))
        if found["schema"]:
            return T.StructType.fromJson(json.loads(found["schema"]))
        if not found["files"]:
            raise ValueError("a folder without files needs a schema")
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
        with closing(_open(found["files"][0])) as db:
            declared = db.execute(f"PRAGMA table_info({_name(self.options.get('table', 'facts'))})").fetchall()
        return T.StructType([T.StructField(r[1], kinds.get(_affinity(r[2] or ""), T.StringType())) for r in declared])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def read(spark: SparkSession, path: str, table: str = "facts", schema: T.StructType | str | None = None, where: Iterable[tuple] = (), **options) -> DataFrame:
    """A table of SQLite files; with a schema only its columns, of rows that meet all conditions (column, sign, value).

    Signs are =, !=, >, >=, <, <=, in (a list), `is null` and `is not null`; null meets none but `is null`, as in SQL.
    """
    spark.dataSource.register(Files)
    reader = spark.read.format(NAME).options(table=table, where=json.dumps(list(where)), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, table: str = "facts", index: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """df as SQLite files in a folder, one for each task that has rows, with an index for each of the named columns."""
    df.sparkSession.dataSource.register(Files)
    df.write.format(NAME).options(table=table, index=",".join(index)).mode(mode).save(path)


def read_facts(spark: SparkSession, path: str, **options) -> DataFrame:
    """Facts with all columns, from files that may be older: missing columns are null, facts without user local's, hashes made."""
    return migrate(read(spark, path, "facts", FACTS, **options), spark.createDataFrame([], FACTS))
