"""Simulation kernels on the synthetic terrain and on parts taken as soils."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import views as V
from landloom.operators import sight, sites, soil, spatial, spread
from landloom.operators.raster import Grid

QUERIES, ORACLES = {}, {}
GRID = Grid(x0=-320.0, y0=320.0, size=10.0, width=64, height=64)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _dem(spark, d):
    return V.terrain(spark, d).withColumnRenamed("z", "v")


_SOIL = "soil as (select p_partkey, (p_partkey % 20) * 5.0::double as sand, least((p_size % 20) * 5.0, 100 - (p_partkey % 20) * 5.0)::double as silt from part)"


@query(f"""with {_SOIL}, t as (select p_partkey, sand as s, silt as i, 100 - sand - silt as c from soil)
select p_partkey, case when i + 1.5*c < 15 then 'sand' when i + 2*c < 30 then 'loamy sand' when c >= 40 and s <= 45 and i < 40 then 'clay' when c >= 40 and i >= 40 then 'silty clay' when c >= 35 and s > 45 then 'sandy clay'
  when c >= 27 and s <= 20 then 'silty clay loam' when c >= 27 and s <= 45 then 'clay loam' when c >= 20 and i < 28 and s > 45 then 'sandy clay loam' when i >= 80 and c < 12 then 'silt' when i >= 50 then 'silt loam'
  when c >= 7 and i >= 28 and s <= 52 then 'loam' else 'sandy loam' end as texture from t""")
def g16_soil_texture(spark, d):
    sand = (F.col("p_partkey") % 20) * F.lit(5.0)
    silt = F.least((F.col("p_size") % 20) * F.lit(5.0), 100 - sand)
    return V.table(spark, d, "part").select("p_partkey", soil.texture(sand, silt, 100 - sand - silt).alias("texture"))


@query("""with p as (select p_partkey, (p_size % 30)::double as s0, 40.0::double as room, (p_partkey % 20 + 1) / 2.0::double as k, (p_partkey % 5 + 2) / 10.0::double as lam from part),
  q as (select *, 3 + 2/lam as m, least(s0/room, 1) as s from p)
select p_partkey, round(greatest((s - case when s > 0 then power(power(s, 1-m) + (m-1)*k*0.5/room, 1/(1-m)) else 0 end) * room, 0), 6) as drained from q""")
def h13_brooks_corey(spark, d):
    c = F.col
    x = soil.brooks_corey((c("p_size") % 30).cast("double"), F.lit(40.0), (c("p_partkey") % 20 + 1) / F.lit(2.0), (c("p_partkey") % 5 + 2) / F.lit(10.0), F.lit(0.5))
    return V.table(spark, d, "part").select("p_partkey", F.round(x, 6).alias("drained"))


@query("""with recursive p as (select p_partkey, (p_size % 10)::double as f0, (p_partkey % 20 + 1) / 2.0::double as k, (p_partkey % 7 + 1) * 10.0::double as s from part),
  b as (select p_partkey, f0, k, s, 0 as n, 0::double as lo, k*0.5 + sqrt(2*k*0.5*s) + s + 1 as hi from p
    union all select p_partkey, f0, k, s, n + 1, case when (lo+hi)/2 - s*ln((f0+(lo+hi)/2+s)/(f0+s)) < k*0.5 then (lo+hi)/2 else lo end, case when (lo+hi)/2 - s*ln((f0+(lo+hi)/2+s)/(f0+s)) < k*0.5 then hi else (lo+hi)/2 end from b where n < 32)
select p_partkey, round(least((lo+hi)/2, 12.0), 5) as infiltrated from b where n = 32""")
def h12_green_ampt(spark, d):
    c = F.col
    x = soil.green_ampt((c("p_size") % 10).cast("double"), (c("p_partkey") % 20 + 1) / F.lit(2.0), (c("p_partkey") % 7 + 1) * F.lit(10.0), F.lit(0.5), F.lit(12.0))
    return V.table(spark, d, "part").select("p_partkey", F.round(x, 5).alias("infiltrated"))


@query("""with h as (select l_partkey as mukey, l_linenumber * 10 as pct, (l_linenumber - 1) * 20.0::double as top, l_linenumber * 20.0::double as bottom, round(l_quantity)::bigint / 10.0::double as ksat, round(l_discount * 100)::bigint / 100.0::double as awc, l_orderkey, l_linenumber from lineitem),
  b as (select mukey, max(pct) as best from h group by 1)
select h.mukey, min(ksat) as ksat_min, round(sum(ksat*(bottom-top)) filter (where ksat > 0.05) / sum(bottom-top) filter (where ksat > 0.05), 6) as ksat_mean, round(sum(awc*(bottom-top)*10), 4) as taw_mm
from h join b on h.mukey = b.mukey and pct = best group by 1""")
def a20_soil_profile(spark, d):
    n = F.col("l_linenumber")
    h = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("mukey"), (n * 10).alias("pct"), ((n - 1) * F.lit(20.0)).alias("top"), (n * F.lit(20.0)).alias("bottom"), (F.round("l_quantity").cast("long") / F.lit(10.0)).alias("ksat"), (F.round(F.col("l_discount") * 100).cast("long") / F.lit(100.0)).alias("awc"))
    return soil.profile_ksat(h).select("mukey", "ksat_min", F.round("ksat_mean", 6).alias("ksat_mean"), F.round("taw_mm", 4).alias("taw_mm"))


@query(V.sql("terrain") + """, f as (select distinct row as r0, 30 as c0 from terrain where row % 64 = 8 and col = 30),
  d as (select row, col, abs(row - r0) as a, abs(col - c0) as b from terrain, f)
select row, col, round(min(10 * (sqrt(2.0) * least(a, b) + greatest(a, b) - least(a, b)) / 2.0), 6) as t from d group by 1, 2""")
def i19_arrival_time(spark, d):
    """Uniform round spread from one cell in every 64 rows, whose eight-neighbour times have a closed form."""
    cells = V.terrain(spark, d).select("row", "col", F.lit(2.0).alias("ros"), F.lit(1.0).alias("ratio"), F.lit(0.0).alias("facing"))
    t = spread.arrival_times(cells, 10.0, (F.col("row") % 64 == 8) & (F.col("col") == 30))
    return t.select("row", "col", F.round("t", 6).alias("t"))


@query()
def h01_fill_depressions(spark, d):
    """Least levels from which each cell drains to the border; held against a heap flood in the tests."""
    return spread.fill_depressions(_dem(spark, d))


_K2 = V.sql("terrain") + """, w as (select s_suppkey::bigint as observer_id, (s_suppkey * 41 % 500 - 250)::double as ox, (315 - 15 * s_suppkey)::double as oy from supplier),
  o as (select w.*, z + 1.7 as eye from w join terrain on row = floor((320 - oy) / 10) and col = floor((ox + 320) / 10)),
  pts as (select observer_id, az, i * 10.0::double as d, ox + i * 10.0 * sin(radians(az * 360.0 / 72)) as x, oy + i * 10.0 * cos(radians(az * 360.0 / 72)) as y, eye from o, range(72) a(az), range(1, 31) s(i)),
  s as (select observer_id, az, d, t.row, t.col, atan2(z - (1 - 1/7.0::double)*d*d/(2*6371000.0) - eye, d) as angle from pts join terrain t on t.row = floor((320 - y) / 10) and t.col = floor((x + 320) / 10)),
  v as (select *, coalesce(angle > max(angle) over (partition by observer_id, az order by d rows between unbounded preceding and 1 preceding) + 1e-7, true) as visible from s)"""


def _swept(spark, d):
    """Sweeps from observers along the strip, one per supplier."""
    k = F.col("s_suppkey").cast("long")
    o = V.table(spark, d, "supplier").select(k.alias("observer_id"), (k * 41 % 500 - 250).cast("double").alias("x"), (315 - 15 * k).cast("double").alias("y"), F.lit(1.7).alias("agl"))
    return sight.sweep(o, _dem(spark, d), GRID, azimuths=72, step=10.0, reach=300.0)


@query(_K2 + " select observer_id, az::int as az, count(*) as n, sum(visible::int)::bigint as seen, round(degrees(max(angle)), 6) as horizon from v group by 1, 2")
def k02_viewshed_sweep(spark, d):
    return _swept(spark, d).groupBy("observer_id", "az").agg(F.count("*").alias("n"), F.sum(F.col("visible").cast("long")).alias("seen"), F.round(F.degrees(F.max("angle")), 6).alias("horizon"))


@query(_K2 + " select distinct row, col from v where visible")
def b09_visible_region(spark, d):
    return sight.viewshed(_swept(spark, d))


@query(_K2 + " select observer_id, count(distinct row * 64 + col) filter (where visible) * 100 as visible_m2, count(distinct row * 64 + col) * 100 as analysed_m2 from v group by 1")
def e19_viewshed_area(spark, d):
    cells = _swept(spark, d).groupBy("observer_id", "row", "col").agg(F.max("visible").alias("visible"))
    return cells.groupBy("observer_id").agg((F.count_if("visible") * 100).alias("visible_m2"), (F.count("*") * 100).alias("analysed_m2"))


@query("""with m as (select month(o_orderdate) * 30 - 15 as yday, count(*)::double as beam from orders group by 1), t as (select yday, beam, h::double as hour, radians(23.45*sin(radians(360.0/365.0*(284+yday)))) as de, radians(15.0*(h-12)) as ha, radians(40.0) as phi from m, range(24) b(h)),
  p as (select *, degrees(asin(least(greatest(sin(phi)*sin(de)+cos(phi)*cos(de)*cos(ha),-1),1))) as el, (degrees(atan2(-sin(ha)*cos(de), cos(phi)*sin(de)-sin(phi)*cos(de)*cos(ha))) + 360) % 360 as az from t),
  e as (select tilt, facing, sum(beam * greatest(sin(radians(el))*cos(radians(tilt)) + cos(radians(el))*sin(radians(tilt))*cos(radians(az - facing)), 0)) as energy
    from p, (select unnest([0.0, 15.0, 30.0, 45.0, 60.0])::double as tilt), (select unnest([90.0, 135.0, 180.0, 225.0, 270.0])::double as facing) where el > 0 group by 1, 2)
select tilt, facing, round(energy, 4) as energy from e""")
def k13_panel_yield(spark, d):
    months = V.table(spark, d, "orders").groupBy((F.month("o_orderdate") * 30 - 15).alias("yday")).agg(F.count("*").cast("double").alias("beam"))
    y = sight.panel_yield(months, 40.0, [0.0, 15.0, 30.0, 45.0, 60.0], [90.0, 135.0, 180.0, 225.0, 270.0])
    return y.select("tilt", "facing", F.round("energy", 4).alias("energy"))


_SITES = V.sql("terrain") + """, c as (select row * 64 + col as id, -320 + (col + 0.5) * 10.0::double as x, 320 - (row + 0.5) * 10.0::double as y, z as elevation, (row * 7 + col * 3) % 36 / 35.0::double as low_slope, (row * 5 + col) % 11 / 10.0::double as dryness, (row * 3 + col) % 17::double as prominence, (row + col * 5) % 13::double as openness from terrain),
  e as (select min(elevation) as lo, max(elevation) as hi from c), s as (select id, x, y, (0.3 * (elevation - lo) / (hi - lo) + 0.3 * prominence / 16 + 0.15 * openness / 12 + 0.15 * low_slope + 0.1 * dryness) / 1.0 as score from c, e)"""


def _scored(spark, d):
    r, c = F.col("row"), F.col("col")
    cand = _dem(spark, d).select((r * 64 + c).alias("id"), GRID.x(c).alias("x"), GRID.y(r).alias("y"), F.col("v").alias("elevation"), ((r * 7 + c * 3) % 36 / F.lit(35.0)).alias("low_slope"), ((r * 5 + c) % 11 / F.lit(10.0)).alias("dryness"), ((r * 3 + c) % 17).cast("double").alias("prominence"), ((r + c * 5) % 13).cast("double").alias("openness"))
    return sites.score(cand, "overlook")


@query(_SITES + " select id, round(score, 10) as score from s")
def h23_site_scores(spark, d):
    return _scored(spark, d).select("id", F.round("score", 10).alias("score"))


@query()
def f09_spaced_sites(spark, d):
    """The best twelve sites 150 m apart; held against the greedy loop in the tests."""
    s = _scored(spark, d).withColumn("score", F.round("score", 8))
    return spatial.spaced(s, "score", 12, 150.0)
