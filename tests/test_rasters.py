"""GeoTIFF files: round trips, foreign coordinates, overlapping files, refusals, and the grid contract."""

import json
import struct
import zlib

import numpy as np
import pytest

from landloom.functions import geo
from landloom.operators.filters import QueryError
from landloom.operators.raster import Grid
from landloom.sources import files, geotiff

EAST, NORTH, ZONE = 476000.0, 4428000.0, 13
GRID = Grid(-50.0, 60.0, 10.0, 10, 12)


def cells(spark, v):
    return spark.createDataFrame([(r, c, float(x)) for r, row in enumerate(v) for c, x in enumerate(row)], "row long, col long, v double")


def read(spark, path, **options):
    spark.dataSource.register(geotiff.GeoTiffSource)
    return spark.read.format("landloom_geotiff").options(**options).load(str(path))


@pytest.mark.parametrize("dtype", ["f4", "f8", "i2", "u1", "i4"])
def test_round_trip_in_small_tasks(spark, tmp_path, dtype):
    v = np.random.default_rng(0).integers(0, 200, (150, 7)).astype(dtype)
    (tmp_path / "a.tif").write_bytes(geotiff.encoded(v, 10.0, 20.0, 2.0, 32613, nodata=7, strip=16))
    (tmp_path / "skip.txt").write_text("no raster")
    df = read(spark, tmp_path, cellsPerTask="100")
    got = {(r.row, r.col): r.v for r in df.collect()}
    assert df.rdd.getNumPartitions() == 10
    assert got == {(r, c): None if v[r, c] == 7 else float(v[r, c]) for r in range(150) for c in range(7)}


def test_tiles_and_prediction(spark, tmp_path):
    """A big-endian file of 16 x 16 tiles with horizontal differences, made by hand."""
    v = np.random.default_rng(1).integers(0, 60000, (20, 30)).astype(">u2")
    tiles = []
    for r in (0, 16):
        for c in (0, 16):
            t = np.zeros((16, 16), ">u2")
            part = v[r : r + 16, c : c + 16]
            t[: part.shape[0], : part.shape[1]] = part
            t[:, 1:] = (t[:, 1:].astype(np.int64) - t[:, :-1]) % 65536
            tiles.append(zlib.compress(t.astype(">u2").tobytes()))
    entries = [(256, 3, [30]), (257, 3, [20]), (258, 3, [16]), (259, 3, [8]), (277, 3, [1]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, None), (325, 4, [len(t) for t in tiles]), (339, 3, [1]), (33550, 12, [0.5, 0.5, 0.0]), (33922, 12, [0, 0, 0, -105.0, 40.0, 0]), (34735, 3, [1, 1, 0, 1, 2048, 0, 1, 4326])]
    code = {3: "H", 4: "I", 12: "d"}
    after = 8 + 2 + 12 * len(entries) + 4
    extra = sum(len(x) * struct.calcsize(code[k]) for _, k, x in entries if x and len(x) * struct.calcsize(code[k]) > 4) + 16
    at = after + extra
    places = [at + sum(map(len, tiles[:i])) for i in range(4)]
    head, tail = struct.pack(">2sHIH", b"MM", 42, 8, len(entries)), b""
    for tag, kind, x in entries:
        x = places if x is None else x
        body = struct.pack(">" + code[kind] * len(x), *x)
        head += struct.pack(">HHI", tag, kind, len(x)) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(">I", after + len(tail)))
        tail += body if len(body) > 4 else b""
    (tmp_path / "t.tif").write_bytes(head + struct.pack(">I", 0) + tail + b"".join(tiles))
    h = geotiff.read_header(str(tmp_path / "t.tif"))
    assert (h.epsg, h.x0, h.y0, h.dx, h.across) == (4326, -105.0, 40.0, 0.5, 2)
    got = {(r.row, r.col): r.v for r in read(spark, tmp_path / "t.tif").collect()}
    assert got == {(r, c): float(v[r, c]) for r in range(20) for c in range(30)}


def test_overlapping_files_by_rank(spark, tmp_path):
    v = np.arange(120.0).reshape(12, 10)
    path = f"file://{tmp_path}/dem"
    told = geotiff.write_geotiff(cells(spark, v), path, GRID, 32613, EAST, NORTH, rows=5, overlap=2).collect()
    assert sorted(r.cells for r in told) == [20, 70, 70]
    # the second file disagrees where the first has a value, and fills a hole of it
    low = v[5:12].copy() + 1000
    (tmp_path / "dem" / "tile-00000001.tif").write_bytes(geotiff.encoded(low.astype("f4"), EAST - 50, NORTH + 60 - 50, 10.0, 32613))
    top = v[:7].copy()
    top[6, 3] = -99999
    (tmp_path / "dem" / "tile-00000000.tif").write_bytes(geotiff.encoded(top.astype("f4"), EAST - 50, NORTH + 60, 10.0, 32613))
    got = {(r.row, r.col): r.v for r in geotiff.mosaic(spark, path, GRID, ZONE, EAST, NORTH).collect()}
    want = {(r, c): v[r, c] if r < 7 and (r, c) != (6, 3) else v[r, c] + 1000 for r in range(12) for c in range(10)}
    assert got == want
    grid = geotiff.contract_grid(spark.createDataFrame([(*k, x) for k, x in got.items() if k != (0, 0)], "row long, col long, v double"), GRID)
    doc = json.loads(grid.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) as j").first().j)
    (tmp_path / "grid.json").write_text(json.dumps(doc))
    assert len(doc["heights"]) == 120 and doc["heights"][0] is None
    assert files.grid_problems(spark, str(tmp_path / "grid.json")).count() == 0
    with pytest.raises(QueryError):
        geotiff.contract_grid(grid, Grid(0, 0, 1, 1000, 1000))


@pytest.mark.parametrize("epsg", [4326, 32612])
def test_files_in_other_coordinates(spark, tmp_path, epsg):
    """A plane, so that the value under a cell tells where it was read."""
    corners = spark.createDataFrame([(EAST + dx, NORTH + dy) for dx in (-200.0, 200.0) for dy in (-200.0, 200.0)], "e double, n double")
    at = geo.from_utm(corners["e"], corners["n"], ZONE)
    if epsg != 4326:
        at = geo.to_utm(at["lon"], at["lat"], 12)
    p = np.array([tuple(r[0]) for r in corners.select(at).collect()])
    x0, y0, size = p[:, 0].min(), p[:, 1].max(), (p[:, 1].max() - p[:, 1].min()) / 400
    w, h = int((p[:, 0].max() - x0) / size), int((y0 - p[:, 1].min()) / size)
    v = x0 + (np.arange(w) + 0.5)[None, :] * size + 0 * np.arange(h)[:, None]
    (tmp_path / "p.tif").write_bytes(geotiff.encoded(v, x0, y0, size, epsg))
    got = geotiff.mosaic(spark, str(tmp_path), GRID, ZONE, EAST, NORTH)
    back = spark.range(120).selectExpr(f"{EAST - 45} + id % 10 * 10 as e", f"{NORTH + 55} - floor(id / 10) * 10 as n", "floor(id / 10) as row", "id % 10 as col")
    q = geo.from_utm(back["e"].cast("double"), back["n"].cast("double"), ZONE)
    q = q["lon"] if epsg == 4326 else geo.to_utm(q["lon"], q["lat"], 12)["e"]
    both = got.join(back.select("row", "col", q.alias("x")), ["row", "col"]).collect()
    assert len(both) == 120 and max(abs(r.v - r.x) for r in both) <= size * 0.5001


def test_refusals(tmp_path):
    (tmp_path / "a.tif").write_bytes(b"PNG not a tiff")
    with pytest.raises(QueryError):
        geotiff.read_header(str(tmp_path / "a.tif"))
    with pytest.raises(QueryError):
        geotiff.files_under(str(tmp_path / "none"))
