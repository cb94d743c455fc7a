"""GeoTIFF rasters as a Spark data source of cells, their writer, and mosaics of them on a grid.

``spark.dataSource.register(GeoTiffSource)``, then ``spark.read.format("landloom_geotiff").load(path)`` for a file or a folder of ``.tif``
files. A task reads a few strips or tiles of one file, by their byte ranges. One band; uncompressed or deflate, with or without
horizontal prediction; UTM and geographic coordinates. Paths may be local ones that all executors share, or URIs that Arrow can open.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from landloom.functions import geo
from landloom.operators.filters import QueryError
from landloom.operators.raster import Grid

# TIFF field types as struct codes, the tags and keys read, and how samples are laid out.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, BANDS, STRIP_ROWS, SIZES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT, SCALE, TIE, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072
KINDS = {1: "u", 2: "i", 3: "f"}
#: Cells of a contract grid, at most: it is one JSON document.
MAX_CELLS = 600_000
SCHEMA = "file string, row long, col long, v double"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    """What a file says of its raster; blocks are strips or tiles in rows of ``across``."""

    file: str
    order: str
    width: int
    height: int
    dtype: str
    compression: int
    predictor: int
    block: tuple[int, int]
    offsets: list[int]
    sizes: list[int]
    epsg: int
    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])


def read_header(path: str) -> Header:
    system, name = opened(path)
    with system.open_input_file(name) as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read(2))
        if order is None:
            raise QueryError("not a TIFF file", file=path)
        (magic,) = struct.unpack(order + "H", f.read(2))
        big = magic == 43
        if big:
            f.read(4)
        (at,) = struct.unpack(order + ("Q" if big else "I"), f.read(8 if big else 4))
        f.seek(at)
        (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
        size, inline = (20, 8) if big else (12, 4)
        raw = f.read(n * size)
        tags = {}
        for i in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, i * size)
            (count,) = struct.unpack_from(order + ("Q" if big else "I"), raw, i * size + 4)
            code = TYPES.get(kind)
            if code is None:
                continue
            length = count * struct.calcsize(code)
            where = i * size + (12 if big else 8)
            if length <= inline:
                body = raw[where : where + length]
            else:
                f.seek(struct.unpack_from(order + ("Q" if big else "I"), raw, where)[0])
                body = f.read(length)
            tags[tag] = body if code == "s" else list(struct.unpack(order + code * count, body))
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    if one(BANDS, 1) != 1 or one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2):
        raise QueryError("only one band, uncompressed or deflate, is read", file=path)
    if SCALE not in tags or TIE not in tags:
        raise QueryError("the raster has no place", file=path)
    keys = tags.get(KEYS, [])
    known = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    tiled = TILE_OFFSETS in tags
    block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, one(HEIGHT)), one(HEIGHT)), one(WIDTH))
    (dx, dy, *_), (i, j, _, x, y, *_) = tags[SCALE], tags[TIE]
    text = tags.get(NODATA, b"").split(b"\0")[0].strip()
    return Header(
        path, order, one(WIDTH), one(HEIGHT), f"{order}{KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}", one(COMPRESSION, 1), one(PREDICTOR, 1), block,
        tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_SIZES if tiled else SIZES], known.get(PROJECTED_KEY) or known.get(GEOGRAPHIC_KEY) or 0, x - i * dx, y + j * dy, dx, dy, float(text) if text else None,
    )


def files_under(path: str) -> list[str]:
    system, name = opened(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise QueryError("no such raster", path=path)
    if info.type != fs.FileType.Directory:
        return [path]
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted(prefix + i.path for i in found if i.type == fs.FileType.File and i.path.lower().endswith((".tif", ".tiff")))


class Blocks(InputPartition):
    def __init__(self, header: Header, first: int, last: int):
        self.header, self.first, self.last = header, first, last


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landloom_geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return GeoTiffReader(self.options)


class GeoTiffReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.cells = options["path"], int(options.get("cellsPerTask", "1000000"))

    def partitions(self):
        found = []
        for path in files_under(self.path):
            h = read_header(path)
            step = max(1, self.cells // (h.block[0] * h.block[1]))
            found += [Blocks(h, at, min(at + step, len(h.offsets))) for at in range(0, len(h.offsets), step)]
        return found

    def read(self, part):
        h = part.header
        system, name = opened(h.file)
        rows, cols = h.block
        with system.open_input_file(name) as f:
            for i in range(part.first, part.last):
                top, left = i // h.across * rows, i % h.across * cols
                high = min(rows, h.height - top)
                f.seek(h.offsets[i])
                body = f.read(h.sizes[i])
                if h.compression != 1:
                    body = zlib.decompress(body)
                values = np.frombuffer(body, h.dtype)
                values = values.reshape(-1, cols)[:high]
                if h.predictor == 2:
                    values = np.cumsum(values, axis=1, dtype=values.dtype)
                wide = min(cols, h.width - left)
                v = values[:, :wide].astype(float).ravel()
                bad = ~np.isfinite(v) if h.nodata is None else ~np.isfinite(v) | (v == h.nodata)
                r, c = np.divmod(np.arange(v.size), wide)
                yield pa.record_batch([pa.array([h.file] * v.size, pa.string()), pa.array(r + top), pa.array(c + left), pa.array(v, mask=bad)], names=["file", "row", "col", "v"])


def encoded(values: np.ndarray, x0: float, y0: float, size: float, epsg: int, nodata: float = -99999.0, strip: int = 64) -> bytes:
    """A GeoTIFF of one band in deflated strips; ``x0, y0`` is the north-west corner."""
    v = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    strips = [zlib.compress(v[i : i + strip].tobytes()) for i in range(0, len(v), strip)]
    key = GEOGRAPHIC_KEY if epsg == 4326 else PROJECTED_KEY
    text = f"{nodata:g}".encode() + b"\0"
    tags = {
        WIDTH: ("I", [v.shape[1]]), HEIGHT: ("I", [v.shape[0]]), BITS: ("H", [v.dtype.itemsize * 8]), COMPRESSION: ("H", [8]), OFFSETS: ("I", [0] * len(strips)), BANDS: ("H", [1]), STRIP_ROWS: ("I", [strip]),
        SIZES: ("I", [len(s) for s in strips]), FORMAT: ("H", [{"u": 1, "i": 2, "f": 3}[v.dtype.kind]]), SCALE: ("d", [size, size, 0.0]), TIE: ("d", [0.0, 0.0, 0.0, x0, y0, 0.0]),
        KEYS: ("H", [1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, key, 0, 1, epsg]), NODATA: ("s", [text]),
    }
    body = lambda code, x: x[0] if code == "s" else struct.pack("<" + code * len(x), *x)
    after = 8 + 2 + 12 * len(tags) + 4
    extra = sum(len(body(*t)) for t in tags.values() if len(body(*t)) > 4)
    at, offsets = after + extra, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    tags[OFFSETS] = ("I", offsets)
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag, (code, x) in sorted(tags.items()):
        b, kind = body(code, x), next(k for k, c in TYPES.items() if c == code)
        count = len(b) if code == "s" else len(x)
        head += struct.pack("<HHI", tag, kind, count) + (b.ljust(4, b"\0") if len(b) <= 4 else struct.pack("<I", after + len(tail)))
        tail += b if len(b) > 4 else b""
    return head + struct.pack("<I", 0) + tail + b"".join(strips)


def write_geotiff(cells: DataFrame, path: str, grid: Grid, epsg: int, east: float = 0.0, north: float = 0.0, rows: int = 512, overlap: int = 0, dtype: str = "f4", nodata: float = -99999.0) -> DataFrame:
    """Writes ``row, col, v`` as files of ``rows`` grid rows under ``path``, each with ``overlap`` more to the south; gives ``file, cells``.

    ``east, north`` is where the scene's origin lies in ``epsg``. A task writes a file whole; missing cells get ``nodata``.
    """
    last = F.floor(F.col("row") / rows)
    first = F.greatest(F.floor((F.col("row") - overlap) / rows), F.lit(0)) if overlap else last
    tiles = cells.where("v is not null").select("row", "col", F.col("v").cast("double").alias("v"), F.explode(F.sequence(first, last)).alias("tile"))

    def write(f: pd.DataFrame) -> pd.DataFrame:
        tile = int(f["tile"].iloc[0])
        top = tile * rows
        values = np.full((int(f["row"].max()) - top + 1, grid.width), nodata, dtype)
        values[f["row"].to_numpy() - top, f["col"].to_numpy()] = f["v"].to_numpy()
        name = f"{path.rstrip('/')}/tile-{tile:08d}.tif"
        system, at = opened(name)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(at) as out:
            out.write(encoded(values, east + grid.x0, north + grid.y0 - top * grid.size, grid.size, epsg, nodata))
        return pd.DataFrame({"file": [name], "cells": [len(f)]})

    return tiles.groupBy("tile").applyInPandas(write, "file string, cells long")


def _projected(e, n, zone: int, epsg: int):
    """Columns x, y in ``epsg`` of UTM coordinates in ``zone`` (north)."""
    if epsg == 32600 + zone:
        return e, n
    at = geo.from_utm(e, n, zone)
    if epsg == 4326:
        return at["lon"], at["lat"]
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        to = geo.to_utm(at["lon"], at["lat"], epsg % 100, epsg > 32700)
        return to["e"], to["n"]
    raise QueryError("unknown coordinates", epsg=epsg)


def mosaic(spark: SparkSession, path: str, target: Grid, zone: int, east: float, north: float) -> DataFrame:
    """``row, col, v`` of the target grid: the nearest cell of the first file (by name) that has a value there; null cells are left out.

    The target is in scene metres with its origin at ``east, north`` of a UTM zone; files may have coordinates of their own. Every target cell
    is projected back into each kind of coordinates that the files use and meets the files of its neighbourhood by an equi-join.
    """
    spark.dataSource.register(GeoTiffSource)
    heads = [read_header(p) for p in files_under(path)]
    i = F.col("id")
    cells = spark.range(target.width * target.height).select(F.floor(i / target.width).alias("trow"), (i % target.width).alias("tcol"))
    want = None
    for epsg in sorted({h.epsg for h in heads}):  # a few kinds of coordinates
        own = [(h.file, n, h.x0, h.y0, h.dx, h.dy, h.width, h.height) for n, h in enumerate(heads) if h.epsg == epsg]
        reach = max(max(o[6] * o[4], o[7] * o[5]) for o in own)
        files = spark.createDataFrame(own, "file string, rank long, x0 double, y0 double, dx double, dy double, w long, h long")
        span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach)))
        files = files.withColumn("bx", span(F.col("x0"), F.col("x0") + F.col("dx") * F.col("w"))).withColumn("by", span(F.col("y0") - F.col("dy") * F.col("h"), F.col("y0")))
        x, y = _projected(target.x(F.col("tcol")) + east, target.y(F.col("trow")) + north, zone, epsg)
        at = cells.withColumn("x", x).withColumn("y", y).withColumn("bx", F.floor(F.col("x") / reach)).withColumn("by", F.floor(F.col("y") / reach))
        met = at.join(files, ["bx", "by"]).select("trow", "tcol", "file", "rank", F.floor((F.col("x") - F.col("x0")) / F.col("dx")).alias("col"), F.floor((F.col("y0") - F.col("y")) / F.col("dy")).alias("row"), "w", "h")
        met = met.where("col >= 0 and row >= 0 and col < w and row < h").drop("w", "h")
        want = met if want is None else want.union(met)
    if want is None:
        return spark.createDataFrame([], "row long, col long, v double")
    have = spark.read.format("landloom_geotiff").load(path).where("v is not null")
    found = want.join(have, ["file", "row", "col"]).groupBy("trow", "tcol").agg(F.min_by("v", "rank").alias("v"))
    return found.select(F.col("trow").alias("row"), F.col("tcol").alias("col"), "v")


def contract_grid(cells: DataFrame, grid: Grid) -> DataFrame:
    """One row in the form of a contract grid: heights north to south, bounds at cell centres and half a cell further out.

    Such a grid is one document; more than MAX_CELLS cells are refused.
    """
    if grid.width * grid.height > MAX_CELLS:
        raise QueryError("grid too large", cells=grid.width * grid.height, most=MAX_CELLS)
    i = F.col("id")
    frame = cells.sparkSession.range(grid.width * grid.height).select("id", F.floor(i / grid.width).alias("row"), (i % grid.width).alias("col"))
    # structs keep null heights in the list, which orders it, too
    whole = frame.join(cells.select("row", "col", "v"), ["row", "col"], "left").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("z"), F.min("v").alias("minElevation"), F.max("v").alias("maxElevation"))
    half = grid.size / 2
    right, low = grid.x0 + grid.size * grid.width, grid.y0 - grid.size * grid.height
    bounds = {"minX": grid.x0 + half, "maxX": right - half, "minY": low + half, "maxY": grid.y0 - half, "outerMinX": grid.x0, "outerMaxX": right, "outerMinY": low, "outerMaxY": grid.y0}
    return whole.select(F.lit(grid.width).alias("width"), F.lit(grid.height).alias("height"), F.transform("z", lambda z: z["v"]).alias("heights"), *[F.lit(float(v)).alias(k) for k, v in bounds.items()], "minElevation", "maxElevation")
