"""SQLite and GeoPackage tables as a Spark data source, split by row id.

``spark.dataSource.register(SqliteSource)``, then ``spark.read.format("landloom_sqlite").option("table", ...).load(path)``. The file has
to be at that path on every executor.
"""

from __future__ import annotations

import sqlite3
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf

KINDS = {"INT": "long", "REAL": "double", "DOUB": "double", "FLOA": "double", "BLOB": "binary", "POIN": "binary", "GEOM": "binary", "LINE": "binary", "POLY": "binary"}


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landloom_sqlite"

    def schema(self) -> str:
        with _connect(self.options["path"]) as con:
            columns = con.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1]}` {next((v for k, v in KINDS.items() if k in (c[2] or '').upper()), 'string')}" for c in columns)

    def reader(self, schema):
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.rows, self.fields = options["path"], options["table"], int(options.get("rowsPerTask", "100000")), schema

    def partitions(self):
        with _connect(self.path) as con:
            low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, -1)]
        return [Rows(at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]

    def read(self, part):
        names = ", ".join(_quoted(f.name) for f in self.fields)
        with _connect(self.path) as con:
            cursor = con.execute(f"select {names} from {_quoted(self.table)} where rowid between ? and ? order by rowid", (part.low, part.high))
            yield from cursor


def point_of(blob: bytes | None) -> dict | None:
    """The point in a GeoPackage geometry blob: a header (magic, version, flags, id, optional envelope), then WKB."""
    if not blob or blob[:2] != b"GP":
        return None
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    wkb = blob[8 + envelope :]
    order = "<" if wkb[0] else ">"
    kind, x, y = struct.unpack(f"{order}Idd", wkb[1:21])
    return {"x": x, "y": y} if kind % 1000 == 1 else None


def gpkg_point(blob: Column) -> Column:
    """``struct<x, y>`` of GeoPackage point blobs."""
    @pandas_udf("x double, y double")
    def decode(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([point_of(b) or {"x": None, "y": None} for b in s], columns=["x", "y"])

    return decode(blob)


def point_blob(x: float, y: float, srs: int = 0) -> bytes:
    return b"GP\x00\x01" + struct.pack("<i", srs) + struct.pack("<BIdd", 1, 1, x, y)

