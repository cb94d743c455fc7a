"""A fire from fuel to arrival: fuel codes from vegetation, ignition, behaviour on a grid, burned ground, embers, readings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions import fire, sentences
from landloom.functions.climate import clamp
from landloom.session import checkpointed

from . import fuelbed as B
from . import layers, raster, spread, stems
from .filters import QueryError

# Thresholds of the crosswalk, codes that never carry crown fire, how far an ignition may be moved (m).
FOREST_TREES, HARDWOOD_BELOW, MIXED_BELOW, CLOSED_COVER, LOW_TREES, LOW_SHARE, SHRUBS, PINES, LOW_COVER = 3, 0.35, 0.60, 40.0, 9.0, 0.15, 5, 0.50, 50.0
LITTER, SNAP = (182, 186, 189), 60.0
#: What cells need of a bed.
BED = ("reaction", "base_ros", "wind_scale", "wind_power", "slope_scale")


def crosswalk(base: Column, life: Column, cover: Column, trees: Column, shrubs: Column, small_share: Column, mean_height: Column, evergreen: Column, pine: Column, conifer: Column) -> Column:
    """The fuel code of a cell from its mapped code (``base``) and local vegetation; shares are 0 to 1, ``cover`` is in %.

    Ground that is mapped as bare or grass keeps its code, and a cell without one is 91. A null share or count is none.
    """
    none = lambda c: F.coalesce(c, F.lit(0.0))
    kept = base.isNull() | base.between(91, 99) | base.between(101, 149)
    wooded = ~kept & (F.coalesce(life == "tree", F.lit(False)) | (none(trees) >= FOREST_TREES))
    layered = (none(shrubs) >= SHRUBS) | (none(small_share) >= LOW_SHARE)
    thin = (none(cover) < LOW_COVER) | F.coalesce(mean_height < LOW_TREES, F.lit(False))
    needles = F.when(none(pine) >= PINES, 188).when((none(conifer) >= none(pine)) & thin, 183).otherwise(185)
    hardwood = F.when(none(cover) >= CLOSED_COVER, 186).otherwise(182)
    found = F.when(none(evergreen) < HARDWOOD_BELOW, hardwood).when(layered, 162).when(none(evergreen) < MIXED_BELOW, 185).otherwise(needles)
    return F.when(wooded, found).otherwise(F.coalesce(base, F.lit(91))).cast("int")


def fuelscape(code: DataFrame, canopy: dict[str, DataFrame], source: raster.Grid, target: raster.Grid) -> DataFrame:
    """``row, col, code`` and canopy ``cc_pct, ch_m, cbh_m, cbd`` on a target grid, by the nearest source cell.

    Canopy rasters ``cc, ch, cbh, cbd`` come in %, decimetres, decimetres and hundredths of kg/m3.
    """
    found = raster.resample(code, source, target).select("row", "col", F.col("v").cast("int").alias("code"))
    for name, (column, scale) in {"cc": ("cc_pct", 1.0), "ch": ("ch_m", 10.0), "cbh": ("cbh_m", 10.0), "cbd": ("cbd", 100.0)}.items():
        found = found.join(raster.resample(canopy[name], source, target).select("row", "col", (F.col("v") / scale).alias(column)), ["row", "col"], "left")
    return found


def ignitions(cells: DataFrame, grid: raster.Grid, points: DataFrame, point_id: str) -> DataFrame:
    """``point_id, row, col, moved``: the burnable cell where each point (``x, y``) starts a fire: its own, else the nearest within SNAP metres.

    ``cells`` has ``row, col, burnable``. Points with no such cell are left out.
    """
    at = points.select(point_id, grid.col(F.col("x")).alias("c"), grid.row(F.col("y")).alias("r")).select(point_id, grid.x(F.col("c")).alias("x"), grid.y(F.col("r")).alias("y"))
    found = stems.snap(at, cells.where("burnable").select("row", "col"), grid, point_id, SNAP)
    moved = F.hypot(grid.x(F.col("col")) - F.col("x"), grid.y(F.col("row")) - F.col("y"))
    return found.join(at, point_id).select(point_id, "row", "col", moved.alias("moved"))


def point_ignition(cells: DataFrame, grid: raster.Grid, x: float, y: float) -> DataFrame:
    """``row, col`` of one ignition; refused off the grid and too far from fuel."""
    if not (grid.x0 <= x <= grid.x0 + grid.size * grid.width and grid.y0 - grid.size * grid.height <= y <= grid.y0):
        raise QueryError("ignition is outside the grid", x=x, y=y)
    one = cells.sparkSession.createDataFrame([(0, float(x), float(y))], "id int, x double, y double")
    found = checkpointed(ignitions(cells, grid, one, "id"))
    if found.isEmpty():
        raise QueryError("no fuel near the ignition", within=SNAP)
    return found.select("row", "col")


def line_ignition(cells: DataFrame, grid: raster.Grid, points: list[tuple[float, float]]) -> DataFrame:
    """``row, col`` of all cells along a line; refused where it leaves the grid or its ground does not burn."""
    spark = cells.sparkSession
    line = spark.createDataFrame([(0, [(float(x), float(y)) for x, y in points])], "id int, path array<struct<x double, y double>>")
    wide = raster.Grid(grid.x0, grid.y0, grid.size, grid.width, grid.height)
    passed = checkpointed(stems.line_cells(line, wide, "id").join(cells.select("row", "col", "burnable"), ["row", "col"], "left"))
    inside = all(grid.x0 <= x <= grid.x0 + grid.size * grid.width and grid.y0 - grid.size * grid.height <= y <= grid.y0 for x, y in points)
    if len(points) < 2 or not inside or not passed.where("not coalesce(burnable, false)").isEmpty():
        raise QueryError("an ignition line has to lie on ground that burns", points=len(points))
    return passed.select("row", "col")


@dataclass(frozen=True)
class Weather:
    temp_f: float = 60.0
    rh: float = 30.0
    wind_mph: float = 10.0
    wind_to: float = 90.0
    days_since_rain: float = 5.0
    growing: float = 0.7
    foliar: float = 100.0


def behaviour(cells: DataFrame, fuels: DataFrame, weather: Weather) -> DataFrame:
    """Cells (``row, col, code, slope, aspect, cc_pct, cbh_m, cbd`` and perhaps ``barrier``) with how fire burns on them.

    ``ros`` (m/min, of the crowns where they carry fire), ``intensity`` (kW/m), ``flame`` (m), ``crown``, ``ratio`` and ``facing`` of the ellipse, ``burnable``. ``slope`` is
    in degrees; a barrier does not burn. Codes without a fuel model do not burn.
    """
    spark = cells.sparkSession
    lit = F.lit
    dead = fire.dead_moisture(lit(weather.temp_f), lit(weather.rh), lit(weather.days_since_rain))
    live = fire.live_moisture(lit(weather.growing))
    c = F.col
    damp = {"m_dead_1h": dead["m1"], "m_dead_10h": dead["m10"], "m_dead_100h": dead["m100"], "m_herb": live["herb"] / 100, "m_woody": live["woody"] / 100}
    barrier = F.coalesce(c("barrier"), lit(False)) if "barrier" in cells.columns else lit(False)
    # moisture is that of the weather, so a bed reacts alike on all its cells: once per code, and once for the crowns
    bed = B.reaction(B.beds(B.cured(fuels, live["herb"] / 100)).withColumns(damp)).select("code", "burnable", "dynamic", "burns", "residence", *BED)
    crown = B.reaction(B.beds(B.crown_fuel(spark), "crown_").withColumns(damp), "crown_").select(*["crown_" + n for n in BED])
    base = cells.select("row", "col", "code", "slope", "aspect", "cc_pct", "cbh_m", "cbd", barrier.alias("barrier"))
    found = B.with_fuel(base, bed).withColumn("burns", F.coalesce("burns", lit(False)) & ~c("barrier"))
    found = found.withColumns({n: F.when(c("burns"), c(n)).otherwise(0.0) for n in ("reaction", "base_ros")}).join(F.broadcast(crown))
    steep = F.tan(F.radians(c("slope")))
    wind = fire.midflame_wind(lit(weather.wind_mph * B.MPH), c("cc_pct"))
    found = B.with_wind_and_slope(found, wind, steep, c("aspect"), lit(float(weather.wind_to)))
    surface = F.when(c("burns"), c("base_ros") * (1 + c("factor"))).otherwise(0.0)
    found = found.withColumn("surface_ros", surface).withColumn("crown_ros", F.when(c("burns"), B.active_crown_spread(lit(weather.wind_mph), steep)).otherwise(0.0))
    found = checkpointed(found.withColumn("surface_intensity", F.coalesce(B.fireline_intensity(c("surface_ros")), lit(0.0))))
    crowns = B.has_crowns(c("cbh_m"), c("cbd"), lit(weather.foliar)) & ~c("code").isin(*LITTER)
    kind = F.when(crowns, fire.crown_class(c("surface_intensity"), c("cbh_m"), lit(weather.foliar), c("crown_ros"), c("cbd"))).otherwise("surface")
    ros = F.when(c("crown") == "active", F.greatest("surface_ros", "crown_ros")).otherwise(c("surface_ros"))
    found = found.withColumn("crown", kind).withColumn("ros", ros).withColumn("intensity", F.coalesce(B.fireline_intensity(c("ros")), lit(0.0)))
    flame = F.when(c("crown") == "active", fire.flame_length(c("intensity"), True)).otherwise(fire.flame_length(c("intensity")))
    ratio = fire.ellipse_ratio(clamp(c("effective_wind") / B.MPH, 0, B.MAX_WIND))
    return found.select("row", "col", "code", "ros", "intensity", flame.alias("flame"), "crown", ratio.alias("ratio"), F.coalesce("direction", lit(0.0)).alias("facing"), c("burns").alias("burnable"))


def scenario(burning: DataFrame, start: DataFrame, weather: Weather, size: float, minutes: float) -> DataFrame:
    """``burning`` (of ``behaviour``) with ``arrival`` in minutes (infinite: never), ``burned`` within ``minutes`` and ``ember``, in reach of firebrands.

    ``start`` has the ``row, col`` where the fire begins.
    """
    lit_ = start.select("row", "col", F.lit(True).alias("start"))
    cells = checkpointed(burning.join(lit_, ["row", "col"], "left").withColumn("start", F.coalesce("start", F.lit(False))))
    arrival = spread.arrival_times(cells, size, F.col("start")).select("row", "col", F.col("t").alias("arrival"))
    found = cells.join(arrival, ["row", "col"]).withColumn("burned", F.col("arrival") <= minutes)
    strong = F.col("burned") & ((F.col("crown") != "surface") | (F.col("flame") >= 1.2) | (F.col("intensity") >= 500))
    found = checkpointed(found.withColumn("source", strong).drop("start"))
    told = found.where("source").agg(F.max("flame").alias("flame"), F.max(F.col("crown") == "passive").alias("passive"), F.max(F.col("crown") == "active").alias("active")).first()
    reach = 0.0 if told["flame"] is None else fire.ember_reach(weather.wind_mph, told["flame"], told["passive"], told["active"])
    hit = layers.embers(found.select("row", "col", "source", "burned"), size, reach, weather.wind_to, 30.0 if weather.wind_mph < 10 else 22.5)
    return found.join(hit.withColumn("ember", F.lit(True)), ["row", "col"], "left").withColumn("ember", F.coalesce("ember", F.lit(False))).drop("source")


def summary(result: DataFrame, size: float) -> DataFrame:
    """One row: burned and exposed ground, the strongest fire on it, and the share of each crown class among what burned."""
    burned = F.col("burned")
    count = lambda kind: F.count_if(burned & (F.col("crown") == kind))
    ha = size * size / 10_000
    return result.agg(
        F.count_if(burned).alias("burned_cells"), (F.count_if(burned) * ha).alias("burned_ha"), (F.count_if("ember") * ha).alias("ember_ha"), F.max(F.when(burned, F.col("flame"))).alias("most_flame"), F.max(F.when(burned, F.col("intensity"))).alias("most_intensity"),
        F.max(F.when(burned, F.col("arrival"))).alias("last_arrival"), *[(count(k) / F.greatest(F.count_if(burned), F.lit(1))).alias(k) for k in ("surface", "passive", "active")],
    )


def readings(result: DataFrame, points: DataFrame, grid: raster.Grid, point_id: str, minutes: float) -> DataFrame:
    """The fire at points (``x, y``), with the sentences that hold there; points off the grid are left out."""
    at = points.select(point_id, grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).join(result, ["row", "col"])
    crown = F.when(F.col("crown") == "active", 2).when(F.col("crown") == "passive", 1).otherwise(0)
    reached = F.when(F.col("arrival") < float("inf"), F.col("arrival"))
    said = sentences.fire_sentences(F.col("code").cast("string"), F.lit(None).cast("double"), F.col("ros"), reached, F.lit(float(minutes)), F.col("flame"), F.col("intensity"), crown, F.when(F.col("ember"), F.lit(True)))
    return at.select(point_id, "code", "ros", "flame", "crown", reached.alias("arrival"), "burned", "ember", said.alias("sentences"))
