"""Runoff events on the terrain of the events, with soils from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import views as V
from landloom.operators import runoff

from .layers import GRID

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def map_units(spark, d):
    """Soils by map unit; what is not known is null."""
    k, size = F.col("p_partkey").cast("long"), F.col("p_size")
    sand = (k % 20 * 5).cast("double")
    silt = F.least((size % 20 * 5).cast("double"), 100 - sand)
    return V.table(spark, d, "part").select(
        k.alias("mukey"), F.when(k % 9 > 0, sand).alias("sand"), silt.alias("silt"), (100 - sand - silt).alias("clay"), F.when(k % 3 == 0, (size * 4).cast("double")).alias("restrictive_cm"),
        F.when(k % 4 > 0, (size * 3).cast("double")).alias("taw_mm"), F.when(k % 5 > 0, k * 7 % 40 / F.lit(2.0)).alias("ksat_min"), F.when(k % 10 > 0, (k % 30).cast("double")).alias("surface_ksat"),
        F.element_at(F.array(*map(F.lit, ("A", "B", "C", "D", "B/D"))), (k % 5 + 1).cast("int")).alias("hsg"),
        F.when(k % 7 == 0, (size * 5).cast("double")).alias("bedrock_cm"), F.when(k % 11 == 0, (size * 3).cast("double")).alias("water_table_cm"),
    )


def soil_cells(spark, d):
    """The map unit of every cell, with its soil; a cell of an unknown unit has none."""
    i = F.col("event_id")
    cells = V.table(spark, d, "events").select(F.floor(i / 64).cast("long").alias("row"), (i % 64).alias("col"), F.col("user_id").alias("mukey"))
    return cells.join(map_units(spark, d), "mukey", "left")


_UNITS = """mu as (select p_partkey::bigint as mukey, p_partkey as k, p_size as s, (p_partkey % 20 * 5)::double as sand0, least((p_size % 20 * 5)::double, 100 - (p_partkey % 20 * 5)::double) as silt from part),
  units as (select mukey, case when k % 9 > 0 then sand0 end as sand, silt, 100 - sand0 - silt as clay, case when k % 3 = 0 then (s * 4)::double end as restrictive_cm, case when k % 4 > 0 then (s * 3)::double end as taw_mm,
    case when k % 5 > 0 then k * 7 % 40 / 2.0::double end as ksat_min, case when k % 10 > 0 then (k % 30)::double end as surface_ksat, ['A', 'B', 'C', 'D', 'B/D'][k % 5 + 1] as hsg,
    case when k % 7 = 0 then (s * 5)::double end as bedrock_cm, case when k % 11 = 0 then (s * 3)::double end as water_table_cm from mu),
  soils as (select event_id // 64 as row, event_id % 64 as col, e.user_id as mukey, u.* exclude (mukey) from events e left join units u on u.mukey = e.user_id)"""


@query(f"with {_UNITS} select row, col, mukey, sand, silt, clay, taw_mm, hsg, coalesce(ksat_min, surface_ksat) as ksat from soils")
def h07_soil_field(spark, d):
    """Soil of every cell by its map unit."""
    return soil_cells(spark, d).select("row", "col", "mukey", "sand", "silt", "clay", "taw_mm", "hsg", F.coalesce("ksat_min", "surface_ksat").alias("ksat"))


def _state(spark, d, **how):
    twi = ((F.col("row") * 31 + F.col("col") * 17) % 997).cast("double")
    return runoff.hydraulic_state(soil_cells(spark, d).withColumn("twi", twi), **how)


_TEXTURE = "(values " + ", ".join(f"('{t}', {v[0]}::double, {v[1]}::double, {v[3]}::double, {v[4]}::double, {v[5]}::double, {v[6]}::double)" for t, v in runoff.TEXTURES.items()) + ") x(texture, theta_r, wilting, theta_s, pore_index, texture_ksat, suction)"
_STATE = f"""{_UNITS}, a as (select *, (row * 31 + col * 17) % 997 as twi, sand + silt + clay as whole, 100.0 * sand / (sand + silt + clay) as ps, 100.0 * silt / (sand + silt + clay) as pi, 100.0 * clay / (sand + silt + clay) as pc from soils),
  b as (select *, case when whole is null or whole <= 0 then 'sandy loam' when pi + 1.5*pc < 15 then 'sand' when pi + 2*pc < 30 then 'loamy sand' when pc >= 40 and ps <= 45 and pi < 40 then 'clay' when pc >= 40 and pi >= 40 then 'silty clay'
      when pc >= 35 and ps > 45 then 'sandy clay' when pc >= 27 and ps <= 20 then 'silty clay loam' when pc >= 27 and ps <= 45 then 'clay loam' when pc >= 20 and pi < 28 and ps > 45 then 'sandy clay loam'
      when pi >= 80 and pc < 12 then 'silt loam' when pi >= 50 then 'silt loam' when pc >= 7 and pi >= 28 and ps <= 52 then 'loam' else 'sandy loam' end as texture,
    (2 * (rank() over (order by twi) - 1) + count(*) over (partition by twi) - 1) / (2.0::double * (count(*) over () - 1)) as pct,
    case when restrictive_cm is not null then least(700.0::double, greatest(50.0, restrictive_cm * 10)) else 700.0::double end as depth_mm from a),
  c as (select *, least(theta_s - 0.01, wilting + least(greatest(coalesce(taw_mm, 100.0) / greatest(depth_mm, 1.0), 0.02), 0.30)) as theta_fc from b join {_TEXTURE} using (texture)),
  e as (select *, wilting + least(greatest(0.5 + 0.2 * (pct - 0.5), 0.02), 0.98) * greatest(0.01, theta_fc - wilting) as base, least(greatest((pct - 0.85) / 0.15, 0), 1) as wetter,
    least(greatest(coalesce(ksat_min, surface_ksat, case hsg when 'A' then 10.0 when 'B' then 5.7 when 'C' then 2.5 when 'D' then 0.6 when 'B/D' then 0.6 end, 5.7), 0), texture_ksat) as ksat,
    bedrock_cm is not null or water_table_cm is not null as typed from c),
  f as (select *, coalesce(bedrock_cm <= 70, false) or coalesce(water_table_cm <= 70, false) or (not typed and coalesce(restrictive_cm <= 70, false)) as shut, case when typed then least(bedrock_cm, water_table_cm) else restrictive_cm end as floor_cm from e)"""


@query(f"""with {_STATE} select row, col, texture, round(base + wetter * (theta_s - base), 9) as theta, theta_s, round(theta_fc, 9) as theta_fc, round(ksat, 9) as ksat, depth_mm,
  round(case when shut then 0 else ksat end, 9) as lower_ksat, round(case when shut then 0.0 else greatest(floor_cm - 70, 0) * 10 * greatest(theta_s - theta_fc, 0) end, 6) as below_mm from f""")
def h11_hydraulic_state(spark, d):
    s = _state(spark, d)
    return s.select("row", "col", "texture", *[F.round(c, 9).alias(c) for c in ("theta", "theta_s", "theta_fc", "ksat")], "depth_mm", F.round("lower_ksat", 9).alias("lower_ksat"), F.round("below_mm", 6).alias("below_mm"))


def _event(spark, d, given):
    graph = runoff.drainage(V.terrain(spark, d).withColumnRenamed("z", "v"), 10.0, 64)
    return runoff.coupled_event(graph, _state(spark, d).withColumn("p_mm", F.lit(given["p_mm"])), given["hours"], 100.0)


@query()
def h14_coupled_event(spark, d):
    """A 12-hour storm of 2.8 inches on every cell; held against a loop over cells in the tests, its budget is checked in every run."""
    e = _event(spark, d, runoff.forcing("rain", rain_in=2.8, storm_hours=12.0))
    return e.select("row", "col", *[F.round(c, 6).alias(c) for c in runoff.DEPTHS + runoff.VOLUMES])


def _years(spark, d):
    """A water year per order year and customer nation: largest price of a day and of three as depths."""
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year")).agg(F.max(F.floor("o_totalprice") / 1000).alias("peak"), F.count("*").alias("n"))
    return o.select("site", "year", F.col("peak").alias("peak_swe_mm"), (F.col("n") * 7).cast("double").alias("storm_1day_mm"), (F.col("n") * 11).cast("double").alias("storm_3day_mm"))


@query("""with y as (select o_custkey, year(o_orderdate) as y, max(floor(o_totalprice) / 1000) as peak, count(*) * 7.0::double as s1, count(*) * 11.0::double as s3 from orders group by 1, 2)
select round(quantile_cont(peak, 0.5) / 25.4, 1) as median_in, round(quantile_cont(peak, 0.9) / 25.4, 1) as p90_in, round(max(peak) / 25.4, 1) as max_in, round(quantile_cont(s1, 0.5) / 25.4, 1) as storm_1day_median_in,
  round(quantile_cont(s1, 0.9) / 25.4, 1) as storm_1day_p90_in, round(max(s1) / 25.4, 1) as storm_1day_max_in, round(max(s3) / 25.4, 1) as storm_3day_max_in, count(*) as n_water_years from y""")
def h17_presets(spark, d):
    return runoff.presets(_years(spark, d))


@query()
def h15_scenario_summary(spark, d):
    """A melt of the median snow pack over four days, summed up: volumes, discharge, and whether it is too small to tell."""
    known = runoff.presets(_years(spark, d)).first().asDict()
    given = runoff.forcing("snowmelt", known=known, melt_days=4.0)
    return runoff.summary(_event(spark, d, given), given["hours"], given["peaking"], 100.0)


@query()
def h19_hydrology_at(spark, d):
    """What the storm does at the places of parts, with a sentence each."""
    k = F.col("p_partkey").cast("long")
    points = V.table(spark, d, "part").select("p_partkey", (k * 53 % 640 - 320).cast("double").alias("x"), (319 - k * 29 % (10 * V.terrain_rows(spark, d))).cast("double").alias("y"))
    return runoff.readings(_event(spark, d, runoff.forcing("rain", rain_in=2.8)), points, GRID, "p_partkey")
