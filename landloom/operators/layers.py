"""Map layers: catalog, filters, samples of regions, shares of classes and features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.functions.climate import clamp

from .filters import QueryError, Region
from .raster import Grid
from .spatial import by_cell, covering, points_in_polygons

#: Themes of a layer by the words in its names and descriptions.
THEMES = {
    "soil": ("soil", "ssurgo", "mukey", "mapunit"),
    "ecology": ("ecoregion", "habitat", "species", "gap", "wildlife", "vegetation", "landfire"),
    "water": ("wetland", "stream", "hydro", "water", "flow", "pond", "seep", "watershed"),
    "land_cover": ("land cover", "nlcd", "landfire", "forest", "developed", "cover"),
    "geology": ("geolog", "surficial", "bedrock"),
    "hazard_or_protection": ("hazard", "protected", "rare", "padus", "conservation", "designation"),
    "access": ("road", "trail", "access"),
    "imagery": ("imagery", "aerial", "orthophoto"),
    "hydrology": ("hydrology", "wetness", "runoff", "scenario"),
    "survey": ("survey", "qfield", "photo"),
}


def provenance(latest: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest attributes with their run's script as one struct per attribute; the ``id`` attribute is hidden. ``runs`` is the
    small dimension of pipeline runs."""
    named = latest.where("attr <> 'id'").join(runs.select("run_id", "script"), "run_id", "left")
    return named.select("entity_id", "attr", F.struct("value", "observed_at", "run_id", "script", "source").alias("state"))


def filter_options(features: DataFrame, fields: list[str]) -> DataFrame:
    """``field, value``: the distinct non-empty values of each field, in one pass over the features."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return features.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''").distinct()


def match_values(options: DataFrame, field: str, wanted: list[str]) -> DataFrame:
    """``wanted, value``: each requested value with the available one it equals but for case, null if none."""
    if not wanted:
        raise QueryError("no values to reveal", field=field)
    asked = options.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wanted)], "at int, wanted string")
    have = options.where(F.col("field") == field).groupBy(F.lower("value").alias("low")).agg(F.max("value").alias("value"))
    return asked.join(have, F.lower("wanted") == F.col("low"), "left").select("wanted", "value")


def samples(spark: SparkSession, region: Region, target: int = 3000) -> DataFrame:
    """About ``target`` evenly spaced points (``iy, ix, x, y``) of a region's box that lie in it; its centre if none does."""
    a, b, c, d = region.box
    step = max(1.0, math.sqrt(max((c - a) * (d - b), 1.0) / target))
    nx, ny = max(1, int((c - a) / step)), max(1, int((d - b) / step))
    at = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("long").alias("iy"), (F.col("id") % nx).alias("ix"))
    points = at.select("iy", "ix", (a + (F.col("ix") + 0.5) * ((c - a) / nx)).alias("x"), (b + (F.col("iy") + 0.5) * ((d - b) / ny)).alias("y"))
    inside = points.where(region.holds(F.col("x"), F.col("y")))
    centre = spark.range(1).select(F.lit(-1).cast("long").alias("iy"), F.lit(-1).cast("long").alias("ix"), F.lit((a + c) / 2).alias("x"), F.lit((b + d) / 2).alias("y"))
    none = inside.agg(F.count("*").alias("n")).where("n = 0")
    return inside.union(centre.where(region.holds(F.col("x"), F.col("y"))).join(F.broadcast(none)).drop("n"))


def overlap_shares(points: DataFrame, polygons: DataFrame, name: str) -> DataFrame:
    """``name, share`` of the sample points inside the features of each name; overlapping features add up, so a share may exceed 1."""
    total = points.agg(F.count("*").alias("total"))
    inside = points_in_polygons(points, polygons).groupBy(name).agg(F.count("*").alias("n"))
    return inside.join(F.broadcast(total)).select(name, F.round(F.col("n") / F.col("total"), 4).alias("share"))


def coverage(polygons: DataFrame, grid: Grid, name: str, parts: int = 4, ring: str = "ring") -> DataFrame:
    """``row, col, name, share``: the part of each cell that a polygon covers, by ``parts`` x ``parts`` sub-cells."""
    from landloom.functions import geo

    fine = Grid(grid.x0, grid.y0, grid.size / parts, grid.width * parts, grid.height * parts)
    box = geo.bbox(F.col(ring))
    span = lambda lo, hi, top: F.explode(F.sequence(F.greatest(lo, F.lit(0).cast("long")), F.least(hi, F.lit(top - 1).cast("long"))))
    meets = (box["max_x"] >= grid.x0) & (box["min_x"] < grid.x0 + grid.size * grid.width) & (box["min_y"] <= grid.y0) & (box["max_y"] > grid.y0 - grid.size * grid.height)
    at = polygons.where(meets).withColumn("fr", span(fine.row(box["max_y"]), fine.row(box["min_y"]), fine.height)).withColumn("fc", span(fine.col(box["min_x"]), fine.col(box["max_x"]), fine.width))
    hit = at.where(geo.in_ring(fine.x(F.col("fc")), fine.y(F.col("fr")), F.col(ring)))
    return hit.groupBy(F.floor(F.col("fr") / parts).cast("long").alias("row"), F.floor(F.col("fc") / parts).cast("long").alias("col"), name).agg((F.count("*") / (parts * parts)).alias("share"))


def fallback(points: DataFrame, rings: list[tuple[DataFrame, Grid]]) -> DataFrame:
    """Value of the first, finest raster that has one at each point (``x, y``), as ``v``."""
    found = points
    for i, (cells, grid) in enumerate(rings):
        keyed = cells.where("v is not null").select(F.col("row").alias(f"r{i}"), F.col("col").alias(f"c{i}"), F.col("v").alias(f"v{i}"))
        found = found.join(keyed, (grid.row(F.col("y")) == F.col(f"r{i}")) & (grid.col(F.col("x")) == F.col(f"c{i}")), "left").drop(f"r{i}", f"c{i}")
    names = [f"v{i}" for i in range(len(rings))]
    return found.withColumn("v", F.coalesce(*names)).drop(*names)


def point_slopes(points: DataFrame, cells: DataFrame, grid: Grid, point_id: str, step: float = 2.0) -> DataFrame:
    """``point_id, slope`` in degrees from heights ``step`` to all four sides; points with a height missing are left out. Points at one place are asked for once."""
    from .raster import bilinear
    from .spatial import at_places

    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in (("e", step, 0.0), ("w", -step, 0.0), ("n", 0.0, step), ("s", 0.0, -step))])
    four = points.select("x", "y").distinct().select("x", "y", F.explode(sides).alias("o")).select(F.struct("x", "y", F.col("o.side").alias("side")).alias("probe"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    at = lambda s: F.max(F.when(F.col("probe.side") == s, F.col("v")))
    h = bilinear(four, cells, grid, "probe").groupBy("probe.x", "probe.y").agg(*[at(s).alias(s) for s in "ewns"]).dropna()
    slope = h.select("x", "y", F.degrees(F.atan(F.hypot((F.col("e") - F.col("w")) / (2 * step), (F.col("n") - F.col("s")) / (2 * step)))).alias("slope"))
    return at_places(points.select(point_id, "x", "y"), slope).select(point_id, "slope")


def canopy(stems: DataFrame, grid: Grid) -> DataFrame:
    """``row, col, v``: the tallest crown over each cell centre, from stems ``x, y, radius, height``. A crown reaches cells within
    its radius of the stem's own cell, and always that cell."""
    r0, c0 = grid.row(F.col("y")), grid.col(F.col("x"))
    n = F.greatest(F.ceil(F.col("radius") / grid.size), F.lit(1)).cast("int")
    reach = stems.select(r0.alias("r0"), c0.alias("c0"), "radius", "height", F.explode(F.sequence(-n, n)).alias("dr"), n.alias("n"))
    reach = reach.select("*", F.explode(F.sequence(-F.col("n"), F.col("n"))).alias("dc")).where((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) * F.lit(grid.size * grid.size) <= F.col("radius") * F.col("radius"))
    at = reach.select((F.col("r0") + F.col("dr")).alias("row"), (F.col("c0") + F.col("dc")).alias("col"), "height")
    return at.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)).groupBy("row", "col").agg(F.max("height").alias("v"))


def stem_cells(stems: DataFrame, grid: Grid, small_m: float = 4.0) -> DataFrame:
    """Counts and shares of stems (``x, y, height, evergreen``) per cell."""
    at = stems.select(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col"), "height", "evergreen")
    at = at.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    share = lambda test: F.count_if(test) / F.count("*")
    return at.groupBy("row", "col").agg(F.count("*").alias("trees"), share(F.col("evergreen")).alias("evergreen_share"), share(F.col("height") < small_m).alias("small_share"), F.avg("height").alias("mean_height"))


def open_water(green: Column, nir: Column, ndvi: Column, least: float = 0.0, plants: float = 0.2) -> Column:
    """Open water by the normalised difference of green and near infrared, where vegetation is low."""
    return ((green - nir) / (green + nir + 1e-6) >= least) & (ndvi < plants)


def tree_type(physiognomy: Column, nir: Column, split: float) -> Column:
    """evergreen or deciduous from the mapped community, from near infrared where that is mixed, and against the map where
    near infrared is 22 or more beyond the split."""
    mapped = F.when(physiognomy == "Conifer", True).when(physiognomy.isin("Hardwood", "Riparian", "Exotic Tree-Shrub", "Exotic Herbaceous"), False).otherwise(nir < split)
    green = F.when(mapped & (nir > split + 22), False).when(~mapped & (nir < split - 22), True).otherwise(mapped)
    return F.when(green, "evergreen").otherwise("deciduous")


def embers(cells: DataFrame, size: float, reach: float, wind_to_deg: float, half_angle: float) -> DataFrame:
    """``row, col`` of unburned cells (``row, col, source, burned``) in a downwind cone of a source."""
    n = int(math.ceil(reach / size)) if reach > 0 else 0
    offsets = []
    for dr in range(-n, n + 1):
        for dc in range(-n, n + 1):
            turn = (math.degrees(math.atan2(dc, -dr)) - wind_to_deg + 180) % 360 - 180
            if (dr or dc) and math.hypot(dr, dc) * size <= reach and abs(turn) <= half_angle:
                offsets.append((dr, dc))
    if not offsets:
        return cells.limit(0).select("row", "col")
    cone = F.array(*[F.struct(F.lit(dr).cast("long").alias("dr"), F.lit(dc).cast("long").alias("dc")) for dr, dc in offsets])
    hit = cells.where("source").select("row", "col", F.explode(cone).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct()
    return cells.where("not burned").join(hit, ["row", "col"], "left_semi").select("row", "col")


def aet_layer(cells: DataFrame, annual_mm: float, mean_taw: float) -> DataFrame:
    """``row, col, v``: annual evapotranspiration spread by wetness rank and available water (``twi_pct, taw``), its mean kept."""
    taw = F.coalesce("taw", F.lit(mean_taw))
    raw = 0.85 + 0.25 * F.coalesce("twi_pct", F.lit(0.0)) + 0.15 * clamp((taw - mean_taw) / max(mean_taw, 1.0), -0.5, 0.8)
    shaped = cells.select("row", "col", clamp(raw, 0.65, 1.25).alias("m"))
    mean = shaped.agg(F.avg("m").alias("mean"))
    return shaped.join(F.broadcast(mean)).select("row", "col", (annual_mm * F.col("m") / F.col("mean")).alias("v"))


def path_offsets(points: DataFrame, paths: DataFrame, point_id: str, path_id: str, limit: float = 60.0) -> DataFrame:
    """One row: how many points have a path nearer than ``limit``, and their mean and median distance."""
    from .spatial import paths_within

    near = paths_within(points, paths, point_id, path_id, limit).groupBy(point_id).agg(F.min("distance").alias("d")).where(F.col("d") < limit)
    return near.agg(F.count("*").alias("matched"), F.avg("d").alias("mean"), F.median("d").alias("median"))


def crowding(points: DataFrame, r: float, point_id: str) -> DataFrame:
    """``point_id, n``: other points within ``r`` of each point, those without any included. Ids are unique; places are counted once for all their points."""
    from .spatial import dealt, within_distance

    places = points.groupBy("x", "y").agg(F.count("*").alias("here"))
    other = places.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("here").alias("there"))
    n = within_distance(places, other, r).groupBy("x", "y").agg((F.sum("there") - 1).alias("n"))
    return points.select(point_id, "x", "y").join(dealt(n), ["x", "y"], "left").select(point_id, F.coalesce("n", F.lit(0)).alias("n"))


def box_pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of rows whose closed boxes (``box`` and ``rbox``) meet: by shared cells, once each."""
    a, b = covering(left, F.col("box"), size), covering(right, F.col("rbox"), size)
    meets = (F.col("box.min_x") <= F.col("rbox.max_x")) & (F.col("rbox.min_x") <= F.col("box.max_x")) & (F.col("box.min_y") <= F.col("rbox.max_y")) & (F.col("rbox.min_y") <= F.col("box.max_y"))
    # a pair is kept in the first cell that both boxes touch
    first = (F.floor(F.greatest("box.min_x", "rbox.min_x") / size) == F.col("cx")) & (F.floor(F.greatest("box.min_y", "rbox.min_y") / size) == F.col("cy"))
    return by_cell(a).join(by_cell(b), ["cx", "cy"]).where(meets & first).drop("cx", "cy")


def ranked(rows: DataFrame, metric: str, tie: str) -> DataFrame:
    """Rows with ``rank``: the metric falling, ties by ``tie`` rising. For a bounded list of sites."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col(metric).desc(), tie)))


def catalogue(catalog: DataFrame, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Layers of a catalog with the state of each: ``source`` of the manifest, ``features`` in the store, and whether it is ``ready``.

    All three have ``layer``; a layer that only the catalog names stays, with nulls.
    """
    found = catalog.join(manifest.select("layer", "source"), "layer", "left").join(stored.select("layer", "features"), "layer", "left")
    return found.withColumn("ready", F.coalesce(F.col("features") > 0, F.lit(False)))
