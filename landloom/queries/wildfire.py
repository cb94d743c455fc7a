"""Fires on the terrain of the events, with fuels and canopy from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import views as V
from landloom.operators import raster as R
from landloom.operators import wildfire as W

from .fuel import fuels
from .ground import GRID

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STAND = """stand as (select event_id // 64 as row, event_id % 64 as col, case when user_id % 7 = 0 then null when user_id % 7 < 3 then 90 + user_id % 60 else 160 + user_id % 30 end as base,
  ['tree', 'shrub', 'herb'][event_id % 3 + 1] as life, (user_id * 7 % 100)::double as cover, event_id % 6 as trees, event_id % 8 as shrubs, (user_id % 40) / 100.0::double as small, (user_id % 20)::double as height,
  case when event_id % 5 > 0 then (user_id * 3 % 100) / 100.0::double end as green, (user_id * 11 % 100) / 100.0::double as pine, (user_id * 13 % 100) / 100.0::double as conifer from events)"""


def _stand(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    return V.table(spark, d, "events").select(
        F.floor(i / 64).cast("long").alias("row"), (i % 64).alias("col"), F.when(u % 7 == 0, None).when(u % 7 < 3, 90 + u % 60).otherwise(160 + u % 30).alias("base"), F.element_at(F.array(*map(F.lit, ("tree", "shrub", "herb"))), (i % 3 + 1).cast("int")).alias("life"),
        (u * 7 % 100).cast("double").alias("cover"), (i % 6).alias("trees"), (i % 8).alias("shrubs"), (u % 40 / F.lit(100.0)).alias("small"), (u % 20).cast("double").alias("height"), F.when(i % 5 > 0, u * 3 % 100 / F.lit(100.0)).alias("green"),
        (u * 11 % 100 / F.lit(100.0)).alias("pine"), (u * 13 % 100 / F.lit(100.0)).alias("conifer"),
    )


@query(f"""with {_STAND}, k as (select *, coalesce(base is null or base between 91 and 99 or base between 101 and 149, true) as kept, life = 'tree' or trees >= 3 as wooded, shrubs >= 5 or small >= 0.15 as layered, cover < 50 or height < 9 as thin, coalesce(green, 0) as g from stand)
select row, col, (case when kept or not wooded then coalesce(base, 91) when g < 0.35 and cover >= 40 then 186 when g < 0.35 then 182 when layered then 162 when g < 0.6 then 185 when pine >= 0.5 then 188 when conifer >= pine and thin then 183 else 185 end)::int as code from k""")
def i21_fuel_crosswalk(spark, d):
    code = W.crosswalk(*[F.col(c) for c in ("base", "life", "cover", "trees", "shrubs", "small", "height", "green", "pine", "conifer")])
    return _stand(spark, d).select("row", "col", code.alias("code"))


@query("""with e as (select event_id // 64 as row, event_id % 64 as col, user_id as u from events), t as (select r.row, c.col from (select unnest(range(0, (select (max(row) + 1) // 3 from e))) as row) r, range(21) c(col))
select t.row, t.col, (u % 50)::int as code, (u % 101)::double as cc_pct, (u % 300) / 10.0::double as ch_m, (u % 40) / 10.0::double as cbh_m, (u % 30) / 100.0::double as cbd from t join e on e.row = t.row * 3 + 1 and e.col = t.col * 3 + 1""")
def i22_fuelscape(spark, d):
    """Fuel and canopy rasters on a grid three times as coarse, in the units that fire needs."""
    i, u = F.col("event_id"), F.col("user_id")
    e = V.table(spark, d, "events").select(F.floor(i / 64).cast("long").alias("row"), (i % 64).alias("col"), u.alias("u"))
    layer = lambda n: e.select("row", "col", (F.col("u") % n).alias("v"))
    target = R.Grid(GRID.x0, GRID.y0, 30.0, 21, V.terrain_rows(spark, d) // 3)
    return W.fuelscape(layer(50), {"cc": layer(101), "ch": layer(300), "cbh": layer(40), "cbd": layer(30)}, GRID, target)


@query(V.sql("terrain", "classes") + """, c as (select row, col from classes where v = 4), p as (select p_partkey, p_partkey * 53 % 64 as c0, p_partkey * 29 % (select max(row) + 1 from terrain) as r0 from part),
  m as (select p_partkey, row, col, (row - r0) * (row - r0) + (col - c0) * (col - c0) as d2 from p join c on abs(row - r0) <= 6 and abs(col - c0) <= 6 where (row - r0) * (row - r0) + (col - c0) * (col - c0) <= 36)
select p_partkey, arg_min(row, (d2, row, col)) as row, arg_min(col, (d2, row, col)) as col, round(sqrt(min(d2)) * 10, 6) as moved from m group by 1""")
def i24_ignition(spark, d):
    """Where points would start a fire if only one class burned."""
    k = F.col("p_partkey").cast("long")
    points = V.table(spark, d, "part").select("p_partkey", GRID.x(k * 53 % 64).alias("x"), GRID.y(k * 29 % V.terrain_rows(spark, d)).alias("y"))
    cells = V.classes(spark, d).select("row", "col", (F.col("v") == 4).alias("burnable"))
    return W.ignitions(cells, GRID, points, "p_partkey").select("p_partkey", "row", "col", F.round("moved", 6).alias("moved"))


WEATHER = W.Weather(temp_f=85.0, rh=20.0, wind_mph=12.0, wind_to=135.0, days_since_rain=14.0)
MINUTES = 240.0


def _fire(spark, d):
    """One fire in every 128 rows of the strip."""
    dem = V.terrain(spark, d).withColumnRenamed("z", "v")
    i, u = F.col("event_id"), F.col("user_id")
    fuel = V.table(spark, d, "events").select(
        F.floor(i / 64).cast("long").alias("row"), (i % 64).alias("col"), (F.floor(i / 8) % 50).alias("code"), (u % 101).cast("double").alias("cc_pct"), (u % 9).cast("double").alias("cbh_m"), (u % 30 / F.lit(100.0)).alias("cbd"), (i % 64 == 40).alias("barrier"),
    )
    ground = R.slope(dem, 10.0).withColumn("aspect", F.lit(270.0))
    burning = W.behaviour(fuel.join(ground, ["row", "col"]), fuels(spark, d), WEATHER)
    starts = V.terrain(spark, d).where("row % 128 = 10 and col = 12").select(F.col("row").alias("id"), GRID.x(F.col("col")).alias("x"), GRID.y(F.col("row")).alias("y"))
    return W.scenario(burning, W.ignitions(burning.select("row", "col", "burnable"), GRID, starts, "id").select("row", "col"), WEATHER, 10.0, MINUTES)


@query()
def i27_fire_scenario(spark, d):
    """Arrival, burned ground and ember exposure; arrival times are held against Dijkstra's in the tests."""
    f = _fire(spark, d)
    return f.select("row", "col", "code", *[F.round(c, 6).alias(c) for c in ("ros", "intensity", "flame")], "crown", F.when(F.col("arrival") < float("inf"), F.round("arrival", 6)).alias("arrival"), "burned", "ember")


@query()
def i29_fire_at(spark, d):
    """The fire at the places of parts, in sentences."""
    k = F.col("p_partkey").cast("long")
    points = V.table(spark, d, "part").select("p_partkey", GRID.x(k * 53 % 64).alias("x"), GRID.y(k * 29 % V.terrain_rows(spark, d)).alias("y"))
    return W.readings(_fire(spark, d), points, GRID, "p_partkey", MINUTES)


@query()
def i29_fire_summary(spark, d):
    return W.summary(_fire(spark, d), 10.0)
