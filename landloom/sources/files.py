"""Readers for grids, vectors and climate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = "width int, height int, heights array<double>, minX double, maxX double, minY double, maxY double, outerMinX double, outerMaxX double, outerMinY double, outerMaxY double, minElevation double, maxElevation double"
POINT = "struct<x:double,y:double>"


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Contract grids as cells: ``file, row, col, v``, row 0 at the north edge, missing heights null."""
    g = spark.read.schema(GRID).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), "width", F.posexplode("heights").alias("pos", "v"))
    return g.select("file", F.floor(F.col("pos") / F.col("width")).cast("long").alias("row"), (F.col("pos") % F.col("width")).cast("long").alias("col"), "v")


def grid_problems(spark: SparkSession, path: str) -> DataFrame:
    """``file, problem``: every clause of the grid contract that a file breaks."""
    g = spark.read.schema(GRID).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    c = F.col
    half = lambda inner, outer, n, span: F.abs(F.abs(c(inner) - c(outer)) - span / (c(n) - 1) / 2) > 0.51 * span / (c(n) - 1)
    across, down = c("maxX") - c("minX"), c("maxY") - c("minY")
    checks: list[tuple[str, Column]] = [
        ("size missing", c("width").isNull() | c("height").isNull()), ("heights missing", c("heights").isNull()), ("heights do not match the size", F.size("heights") != c("width") * c("height")),
        ("x bounds out of order", c("minX") >= c("maxX")), ("y bounds out of order", c("minY") >= c("maxY")), ("outer x not half a cell out", half("minX", "outerMinX", "width", across)),
        ("outer y not half a cell out", half("minY", "outerMinY", "height", down)), ("lowest height differs", F.abs(F.array_min("heights") - c("minElevation")) > 0.01), ("highest height differs", F.abs(F.array_max("heights") - c("maxElevation")) > 0.01),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks]))
    return g.select("file", F.explode(found).alias("problem"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as ``file, fid, kind, properties`` (JSON text) and ``parts``: an array of point arrays, which are the rings of
    polygons, the paths of lines, or single points."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.parse_json("value").alias("doc"))
    features = raw.select("file", F.from_json(F.to_json(F.variant_get("doc", "$.features", "variant")), "array<struct<properties:variant,geometry:struct<type:string,coordinates:variant>>>").alias("fs"))
    f = features.select("file", F.posexplode("fs").alias("fid", "f")).select("file", "fid", F.col("f.geometry.type").alias("kind"), F.to_json("f.properties").alias("properties"), F.to_json("f.geometry.coordinates").alias("c"))
    deep = lambda n: F.from_json("c", "array<" * n + "double" + ">" * n)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    path_ = lambda line: F.transform(line, point)
    parts = (
        F.when(F.col("kind") == "Point", F.array(F.array(point(deep(1))))).when(F.col("kind").isin("LineString", "MultiPoint"), F.array(path_(deep(2))))
        .when(F.col("kind").isin("Polygon", "MultiLineString"), F.transform(deep(3), path_)).when(F.col("kind") == "MultiPolygon", F.transform(F.flatten(deep(4)), path_))
    )
    return f.select("file", "fid", "kind", "properties", parts.alias("parts"))


#: Header stems of daily climate tables and the names they get.
STEMS = {"year": "year", "yday": "yday", "prcp": "prcp", "tmax": "tmax", "tmin": "tmin", "swe": "swe", "srad": "srad", "dayl": "dayl", "vp": "vp"}


def read_climate(spark: SparkSession, path: str) -> DataFrame:
    """A daily climate CSV with tolerant headers (``prcp (mm/day)`` reads as ``prcp``); 365-day years; ``day`` is added."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    named = [F.col(f"`{c}`").cast("double").alias(STEMS[s]) for c in raw.columns if (s := c.strip().lower().split(" ")[0].split("(")[0]) in STEMS]
    df = raw.select(*named)
    # day 60 on is shifted in leap years, which end on 30 December
    leap = F.col("year").cast("int") % 4 == 0
    day = F.date_add(F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1)), (F.col("yday") - 1).cast("int"))
    return df.withColumn("day", day).withColumn("leap", leap)


def write_payload(df: DataFrame, path: str, order: str = "entity_id") -> None:
    """One JSON line per row, ordered, for a viewer."""
    df.orderBy(order).write.mode("overwrite").json(path)
