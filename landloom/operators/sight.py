"""Visibility over terrain: rays, viewsheds, horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions.sky import curvature_drop

from .raster import Grid, sample


def rays(observers: DataFrame, azimuths: int, step: float, reach: float) -> DataFrame:
    """``observer_id, ox, oy, agl, az, d, x, y``: points along ``azimuths`` rays, ``step`` apart out to ``reach``."""
    o = observers.select("observer_id", F.col("x").alias("ox"), F.col("y").alias("oy"), "agl")
    o = o.withColumn("az", F.explode(F.sequence(F.lit(0), F.lit(azimuths - 1)))).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(int(reach / step)))))
    a, d = F.radians(F.col("az") * 360.0 / azimuths), F.col("i") * F.lit(float(step))
    return o.select("observer_id", "ox", "oy", "agl", "az", d.alias("d"), (F.col("ox") + d * F.sin(a)).alias("x"), (F.col("oy") + d * F.cos(a)).alias("y"))


def sweep(observers: DataFrame, cells: DataFrame, grid: Grid, azimuths: int = 360, step: float | None = None, reach: float = 1000.0, target_agl: float = 0.0, refraction: str = "optical") -> DataFrame:
    """``observer_id, az, d, row, col, angle, visible`` of every ray sample on the grid.

    A sample is visible if its angle of elevation, lowered by the curvature of the earth, exceeds that of everything nearer on
    its ray. One running maximum per ray; rays are independent.
    """
    ground = sample(observers.select("observer_id", "x", "y", "agl"), cells, grid, "inner").select("observer_id", "x", "y", "agl", (F.col("v") + F.col("agl")).alias("eye"))
    # a sample carries its eye's height, and those beyond the cells are left out before anything is dealt
    box = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    points = rays(ground.withColumn("agl", F.col("eye")), azimuths, step or grid.size, reach).withColumnRenamed("agl", "eye")
    points = points.withColumn("row", grid.row(F.col("y"))).withColumn("col", grid.col(F.col("x"))).where(F.col("row").between(*box[:2]) & F.col("col").between(*box[2:]))
    at = points.select("observer_id", "az", "d", "row", "col", "eye").join(cells.select("row", "col", "v"), ["row", "col"])
    rise = F.col("v") - curvature_drop(F.col("d"), refraction) - F.col("eye")
    at = at.withColumn("angle", F.atan2(rise, F.col("d"))).withColumn("target", F.atan2(rise + target_agl, F.col("d")))
    at = at.select("observer_id", "az", "d", "row", "col", "angle", "target")
    nearer = Window.partitionBy("observer_id", "az").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.col("target") > F.max("angle").over(nearer) + 1e-7, F.lit(True))
    return at.select("observer_id", "az", "d", "row", "col", "angle", seen.alias("visible"))


def viewshed(swept: DataFrame) -> DataFrame:
    """``row, col`` seen by at least one observer on at least one ray."""
    return swept.where("visible").select("row", "col").distinct()


def horizon(swept: DataFrame) -> DataFrame:
    """``observer_id, az, deg``: the highest angle of each ray."""
    return swept.groupBy("observer_id", "az").agg(F.degrees(F.max("angle")).alias("deg"))


def line_of_sight(pairs: DataFrame, cells: DataFrame, grid: Grid, samples: int = 200) -> DataFrame:
    """For ``pair_id, x, y, z, x2, y2, z2`` (eye and target heights) the worst clearance over straight samples:
    ``pair_id, clearance, at`` (share of the way), and so whether the target is seen (clearance >= 0)."""
    p = pairs.withColumn("f", F.explode(F.transform(F.sequence(F.lit(1), F.lit(samples - 1)), lambda i: i / F.lit(float(samples)))))
    between = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("f")
    d = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    bulge = curvature_drop(d) * F.col("f") * (1 - F.col("f"))
    at = sample(p.select("pair_id", "f", between("z", "z2").alias("line"), bulge.alias("bulge"), between("x", "x2").alias("sx"), between("y", "y2").alias("sy")).withColumnsRenamed({"sx": "x", "sy": "y"}), cells, grid, "inner")
    clear = F.col("line") - F.col("v") - F.col("bulge")
    return at.groupBy("pair_id").agg(F.min(F.struct(clear.alias("clearance"), F.col("f").alias("at"))).alias("m")).select("pair_id", "m.clearance", "m.at")


def panel_yield(months: DataFrame, lat_deg: float, tilts: list[float], facings: list[float]) -> DataFrame:
    """``tilt, facing, energy``: beam energy on fixed panels over mean days of the months (``month, yday, beam``)."""
    from landloom.functions import sky

    hours = months.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    sun = hours.withColumn("p", sky.solar_position(lat_deg, F.col("yday"), F.col("hour").cast("double"))).where("p.elevation > 0")
    panel = sun.withColumn("tilt", F.explode(F.array(*map(F.lit, tilts)))).withColumn("facing", F.explode(F.array(*map(F.lit, facings))))
    cos = sky.incidence_cosine(F.col("p.elevation"), F.col("p.azimuth"), F.col("tilt"), F.col("facing"))
    return panel.groupBy("tilt", "facing").agg(F.sum(F.col("beam") * cos).alias("energy"))


def best_panel(yields: DataFrame) -> DataFrame:
    """The first best tilt and facing."""
    return yields.agg(F.max(F.struct(F.round("energy", 9).alias("energy"), (-F.col("tilt")).alias("t"), (-F.col("facing")).alias("f"))).alias("m")).select((-F.col("m.t")).alias("tilt"), (-F.col("m.f")).alias("facing"), F.col("m.energy").alias("energy"))
