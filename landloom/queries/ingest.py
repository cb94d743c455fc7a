"""Rasters written from the test tables, read back and brought onto a grid."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from landloom import views as V
from landloom.operators.raster import Grid
from landloom.session import shared_folder
from landloom.sources import geotiff

from .ground import GRID

QUERIES, ORACLES = {}, {}
EAST, NORTH, ZONE = 476000.0, 4428000.0, 13


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _written(spark, cells, **how) -> str:
    path = f"{shared_folder(spark)}/rasters-{uuid.uuid4().hex}"
    geotiff.write_geotiff(cells, path, GRID, 32600 + ZONE, EAST, NORTH, **how).write.format("noop").mode("overwrite").save()
    return path


@query(V.sql("terrain", "classes") + " select row, col, v::double as v from classes where v <> 4")
def a08_raster_ingest(spark, d):
    """Classes as 16-bit files, read by their strips; cells without a class stay out."""
    path = _written(spark, V.classes(spark, d).where("v <> 4"), rows=128, dtype="i2", nodata=-9999.0)
    spark.dataSource.register(geotiff.GeoTiffSource)
    tile = F.regexp_extract("file", r"tile-(\d+)", 1).cast("long")
    return spark.read.format("landloom_geotiff").load(path).where("v is not null").select((F.col("row") + 128 * tile).alias("row"), "col", "v")


@query(V.sql("terrain") + " select row // 3 as row, col // 3 as col, z as v from terrain where row % 3 = 1 and col % 3 = 1 and col < 63 and row < (select (max(row) + 1) // 3 * 3 from terrain)")
def a09_dem_ingest(spark, d):
    """Heights in overlapping files on a grid three times as coarse: the cell under every centre, of overlapping files the first."""
    path = _written(spark, V.terrain(spark, d).select("row", "col", F.col("z").alias("v")), rows=96, overlap=8)
    target = Grid(GRID.x0, GRID.y0, 30.0, 21, V.terrain_rows(spark, d) // 3)
    return geotiff.mosaic(spark, path, target, ZONE, EAST, NORTH)
