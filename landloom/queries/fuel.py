"""Fuel beds and fire behaviour over a fuel table with a model per part size."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import views as V
from landloom.functions import fire
from landloom.operators import fuelbed as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fuels(spark, d):
    """A fuel model per part size but every thirteenth, which the table lacks."""
    k = F.col("code")
    codes = V.table(spark, d, "part").select(F.col("p_size").cast("long").alias("code")).distinct().where(k % 13 != 0)
    return codes.select(
        "code", ((k % 7 + 1) / F.lit(20.0)).alias("dead_1h"), ((k % 5) / F.lit(20.0)).alias("dead_10h"), ((k % 4) / F.lit(20.0)).alias("dead_100h"), ((k % 3) / F.lit(10.0)).alias("herb"), ((k % 6) / F.lit(10.0)).alias("woody"),
        ((k % 9 + 40) * 150.0).alias("sav_dead_1h"), F.lit(358.0).alias("sav_dead_10h"), F.lit(98.0).alias("sav_dead_100h"), ((k % 8 + 30) * 150.0).alias("sav_herb"), ((k % 10 + 25) * 150.0).alias("sav_woody"),
        ((k % 10 + 2) / F.lit(20.0)).alias("depth"), ((k % 4 * 5 + 15) / F.lit(100.0)).alias("extinction"), F.lit(18608.0).alias("heat"), (k % 10 != 0).alias("burnable"), (k % 2 == 0).alias("dynamic"),
    )


LIVE_HERB = 0.75


def cells(spark, d):
    """A cell per part with its bed, the crown bed, moistures, wind, slope and canopy."""
    p, k = V.table(spark, d, "part"), F.col("p_partkey")
    c = p.select(
        "p_partkey", F.col("p_size").cast("long").alias("code"), ((k % 15 + 3) / F.lit(100.0)).alias("m_dead_1h"), ((k % 15 + 4) / F.lit(100.0)).alias("m_dead_10h"), ((k % 15 + 5) / F.lit(100.0)).alias("m_dead_100h"),
        F.lit(LIVE_HERB).alias("m_herb"), ((k % 60 + 60) / F.lit(100.0)).alias("m_woody"), (k % 41).cast("double").alias("mph"), ((k % 7) / F.lit(10.0)).alias("slope"), (k * 7 % 360).cast("double").alias("aspect"),
        (k * 11 % 360).cast("double").alias("downwind"), (k % 9).cast("double").alias("cbh"), ((k % 11) / F.lit(40.0)).alias("cbd"), (k % 40 + 80).cast("double").alias("fmc"),
    )
    crown = B.beds(B.crown_fuel(spark), "crown_")
    found = B.with_fuel(c, B.beds(B.cured(fuels(spark, d), F.lit(LIVE_HERB)))).withColumn("burns", F.coalesce("burns", F.lit(False)))
    # one row
    return B.reaction(B.reaction(found.join(F.broadcast(crown)), "crown_"))


_FUELS = """fuels as (select distinct p_size::bigint as k from part where p_size % 13 <> 0),
 table0 as (select k, unnest([1, 2, 3, 4, 5]) as c, unnest([(k % 7 + 1) / 20.0::double, (k % 5) / 20.0::double, (k % 4) / 20.0::double, (k % 3) / 10.0::double, (k % 6) / 10.0::double]) as load,
   unnest([(k % 9 + 40) * 150.0::double, 358.0, 98.0, (k % 8 + 30) * 150.0::double, (k % 10 + 25) * 150.0::double]) as sav,
   (k % 10 + 2) / 20.0::double as depth, (k % 4 * 5 + 15) / 100.0::double as mx, 18608.0::double as heat, k % 10 <> 0 as burnable, k % 2 = 0 as dynamic from fuels),
 moved as (select k, case when dynamic then load * 0.5::double else 0 end as moved, sav as herb_sav from table0 where c = 4),
 cured as (select t.k, c, case c when 1 then load + moved when 4 then greatest(load - moved, 0) else load end as load, case when c = 1 and load + moved > 0 then (load * sav + moved * herb_sav) / (load + moved) else sav end as sav,
   depth, mx, heat, burnable, dynamic from table0 t join moved m on m.k = t.k),
 crown as (select -10::bigint as k, unnest([1, 2, 3, 4, 5]) as c, unnest([3.01, 2.00, 5.01, 0.0, 2.00])::double * 0.224170231 as load, unnest([2000.0, 109.0, 30.0, 0.0, 1500.0])::double * 3.280839895 as sav, 0.3048::double as depth, 0.25::double as mx,
   8000 * 2.3259999996::double as heat, true as burnable, false as dynamic)"""
_BEDS = (
    _FUELS
    + """, u as (select *, load * 0.204816143622 as w, sav / 3.280839895 as s, c > 3 as live from (select * from cured union all select * from crown)),
 v as (select *, s * w / 32 as area, case when s >= 1200 then 1 when s >= 192 then 2 when s >= 96 then 3 when s >= 48 then 4 when s >= 16 then 5 else 6 end as size from u),
 f as (select *, coalesce(area / nullif(sum(area) over (partition by k, live), 0), 0) as f from v),
 g as (select *, sum(f) over (partition by k, live, size) as g from f),
 kind as (select k, live, sum(area) as area, sum(f * s) as sigma, sum(g * w * (1 - 0.0555)) as net, sum(w) as w from g group by all),
 whole as (select k, sum(area) as area, sum(w) as w from kind group by 1),
 parts as (select a.k, sum(case when not live then a.area / b.area else 0 end) as f_dead, sum(case when live then a.area / b.area else 0 end) as f_live, sum(a.area / b.area * sigma) as sigma, sum(case when not live then net else 0 end) as net_dead,
   sum(case when live then net else 0 end) as net_live from kind a join whole b on a.k = b.k group by 1),
 one as (select k, depth, mx, heat, burnable from u where c = 1),
 bed0 as (select p.*, one.* exclude (k), whole.w / (depth * 3.280839895) as density, whole.w / (depth * 3.280839895) / 32 as beta, burnable and whole.w > 0 and depth > 0 as burns from parts p join whole on whole.k = p.k join one on one.k = p.k),
 bed1 as (select *, beta / (3.348 * pow(sigma, -0.8189)) as rel, 0.02526 * pow(sigma, 0.54) as b, 133 * pow(sigma, -0.7913) as a, 384 / sigma as residence from bed0),
 beds as (select *, 7.47 * exp(-0.133 * pow(sigma, 0.55)) * pow(rel, -0.715 * exp(-3.59e-4 * sigma)) * pow(3.280839895, b) as wind_scale, 5.275 * pow(beta, -0.3) as slope_scale,
   pow(sigma, 1.5) / (495 + 0.0594 * pow(sigma, 1.5)) * pow(rel, a) * exp(a * (1 - rel)) as velocity, exp((0.792 + 0.681 * sqrt(sigma)) * (beta + 0.1)) / (192 + 0.2595 * sigma) as flux from bed1)"""
)
_CELLS = (
    _BEDS
    + """, p as (select p_partkey, p_partkey as i, p_size::bigint as code, (i % 15 + 3) / 100.0::double as m1, (i % 15 + 4) / 100.0::double as m2, (i % 15 + 5) / 100.0::double as m3, 0.75::double as m4, (i % 60 + 60) / 100.0::double as m5, (i % 41)::double as mph,
   (i % 7) / 10.0::double as slope, (i * 7 % 360)::double as aspect, (i * 11 % 360)::double as downwind, (i % 9)::double as cbh, (i % 11) / 40.0::double as cbd, (i % 40 + 80)::double as fmc from part),
 asked as (select p_partkey, code as k, [m1, m2, m3, m4, m5] as m from p union all select p_partkey, -10, [m1, m2, m3, m4, m5] from p),
 x as (select p_partkey, k, live, sum(w * case when s > 0 then exp(case when live then -500 else -138 end / s) else 0 end) as fine, sum(m[c] * w * case when s > 0 then exp(-138 / s) else 0 end) as wet, sum(f * m[c]) as mf,
   sum(f * case when s > 0 then exp(-138 / s) else 0 end * (250 + 1116 * m[c])) as q from asked join g using (k) group by all),
 y as (select p_partkey, k, sum(fine) filter (not live) as dead, sum(fine) filter (live) as green, sum(wet) filter (not live) as wet, sum(mf) filter (not live) as md, sum(mf) filter (live) as ml, sum(q) filter (not live) as qd, sum(q) filter (live) as ql from x group by all),
 z as (select y.*, beds.* exclude (k), density * (f_dead * qd + f_live * ql) as sink, case when green > 0 then greatest(mx, 2.9 * dead / green * (1 - wet / dead / mx) - 0.226) else mx end as lx from y join beds on beds.k = y.k),
 z1 as (select *, least(md / mx, 1) as rd, least(ml / lx, 1) as rl from z),
 z2 as (select *, case when burns and md < mx then (net_dead * greatest(1 - 2.59*rd + 5.11*rd*rd - 3.52*rd*rd*rd, 0) + net_live * greatest(1 - 2.59*rl + 5.11*rl*rl - 3.52*rl*rl*rl, 0)) * heat / 2.3259999996 * 0.174 * pow(0.01, -0.19) * velocity else 0 end as ir from z1),
 z3 as (select *, case when ir > 0 then ir * flux / sink * 0.3048 else 0 end as r0, wind_scale * pow(0.9 * ir * 0.3048, b) as cap from z2),
 cells as (select p.*, n.* exclude (p_partkey, k), coalesce(n.burns, false) as fires, coalesce(n.ir, 0) as reaction, coalesce(n.r0, 0) as base, c.r0 as c_r0, c.cap as c_cap, c.wind_scale as c_wind, c.slope_scale as c_slope, c.b as c_b, c.ir as c_ir
   from p left join z3 n on n.p_partkey = p.p_partkey and n.k = p.code join z3 c on c.p_partkey = p.p_partkey and c.k = -10),
 blown as (select *, wind_scale * pow(mph * 26.8224 * 0.4, b) as pw, slope_scale * slope * slope as ps, 3.34 * c_r0 * (1 + least(c_wind * pow(mph * 26.8224 * 0.4, c_b) + c_slope * slope * slope, c_cap)) as crown from cells),
 vec as (select *, pw * sin(radians(downwind)) + ps * sin(radians(aspect + 180)) as vx, pw * cos(radians(downwind)) + ps * cos(radians(aspect + 180)) as vy from blown),
 lit as (select *, case when fires and reaction > 0 then least(sqrt(vx*vx + vy*vy), cap) else 0 end as factor from vec)"""
)


@query("select p_partkey, p_size::bigint as code, coalesce(p_size % 13 <> 0 and p_size % 10 <> 0, false) as burnable, coalesce(p_size % 13 <> 0 and p_size % 2 = 0, false) as dynamic, case when p_size % 13 <> 0 then (p_size % 10 + 2) / 20.0::double end as depth from part")
def i07_fuel_table(spark, d):
    c = V.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("code"))
    return B.with_fuel(c, fuels(spark, d)).select("p_partkey", "code", "burnable", "dynamic", "depth")


@query("with " + _BEDS + " select k as code, round(sigma, 5) as sigma, round(beta, 8) as packing, round(rel, 6) as relative, round(wind_scale, 8) as wind_scale, round(slope_scale, 6) as slope_scale, round(velocity, 6) as velocity, round(flux, 8) as flux, round(net_dead, 8) as net_dead, round(net_live, 8) as net_live, burns from beds where k > 0")
def i08_fuel_beds(spark, d):
    b = B.beds(B.cured(fuels(spark, d), F.lit(LIVE_HERB)))
    digits = {"sigma": 5, "packing": 8, "relative": 6, "wind_scale": 8, "slope_scale": 6, "velocity": 6, "flux": 8, "net_dead": 8, "net_live": 8}
    return b.select("code", *[F.round(k, n).alias(k) for k, n in digits.items()], "burns")


@query("with " + _FUELS + " select k as code, max(round(load, 8)) filter (c = 1) as dead_1h, max(round(sav, 5)) filter (c = 1) as sav_dead_1h, max(round(load, 8)) filter (c = 4) as herb from cured group by 1")
def i09_cured_loads(spark, d):
    return B.cured(fuels(spark, d), F.lit(LIVE_HERB)).select("code", F.round("dead_1h", 8).alias("dead_1h"), F.round("sav_dead_1h", 5).alias("sav_dead_1h"), F.round("herb", 8).alias("herb"))


@query("with " + _CELLS + " select p_partkey, round(reaction, 4) as reaction, round(base, 7) as base_ros from cells")
def i12_reaction(spark, d):
    return cells(spark, d).select("p_partkey", F.round("reaction", 4).alias("reaction"), F.round("base_ros", 7).alias("base_ros"))


def _blown(spark, d):
    return B.with_wind_and_slope(cells(spark, d), F.col("mph") * B.MPH * B.OPEN_SHARE, F.col("slope"), F.col("aspect"), F.col("downwind"))


@query("with " + _CELLS + " select p_partkey, round(factor, 6) as factor, round(case when factor > 0 then pow(factor / wind_scale, 1 / b) else 0 end, 5) as effective_wind, case when factor > 0 then round((degrees(atan2(vx, vy)) + 360) % 360, 5) end as direction from lit")
def i11_wind_and_slope(spark, d):
    return _blown(spark, d).select("p_partkey", F.round("factor", 6).alias("factor"), F.round("effective_wind", 5).alias("effective_wind"), F.round("direction", 5).alias("direction"))


@query("with " + _CELLS + " select p_partkey, round(crown, 6) as crown_ros from blown")
def i15_active_crown(spark, d):
    return cells(spark, d).select("p_partkey", F.round(B.active_crown_spread(F.col("mph"), F.col("slope")), 6).alias("crown_ros"))


_INDEX = """, w as (select *, fires and cbh > 0 and cbd > 0 as ok, pow(0.010 * cbh * (460 + 25.9 * fmc), 1.5) / nullif(reaction * 0.189273025894 * residence, 0) / nullif(base, 0) - 1 as need, 3.0 / nullif(cbd, 0) / 3.34 / nullif(c_r0, 0) - 1 as c_need from blown),
 wt as (select *, case when not ok then null when need is null or need > cap then 'inf'::double when need - ps <= 0 then 0 else pow((need - ps) / wind_scale, 1 / b) / (26.8224 * 0.4) end as t,
   case when not ok then null when c_need is null or c_need > c_cap then 'inf'::double when c_need - c_slope * slope * slope <= 0 then 0 else pow((c_need - c_slope * slope * slope) / c_wind, 1 / c_b) / (26.8224 * 0.4) end as cc from w),
 wi as (select *, case when t > 120 then 'inf'::double else t end as torching, greatest(case when t > 120 then 'inf'::double else t end, case when cc > 120 then 'inf'::double else cc end) as crowning from wt)"""


@query("with " + _CELLS + _INDEX + " select p_partkey, case when isinf(torching) then -1 else round(torching, 5) end as torching, case when isinf(crowning) then -1 else round(crowning, 5) end as crowning from wi")
def i17_torching_and_crowning(spark, d):
    """Winds without an end are shown as -1."""
    t = B.torching_and_crowning(cells(spark, d), F.col("cbh"), F.col("cbd"), F.col("fmc"), F.col("slope"))
    shown = lambda k: F.when(F.col(k) == float("inf"), -1.0).otherwise(F.round(k, 5)).alias(k)
    return t.select("p_partkey", shown("torching"), shown("crowning"))


@query("with " + _CELLS + """, r as (select *, base * (1 + least(coalesce(pw, 0), coalesce(cap, 0))) as flat, base * (1 + factor) as ros from lit), i as (select *, reaction * 0.189273025894 * coalesce(residence, 0) * ros as intensity from r)
select p_partkey, round(flat, 6) as base_ros, round(ros, 6) as slope_ros, round(intensity, 4) as intensity, round(0.0775 * pow(intensity, 0.46), 6) as flame,
  case when not (fires and cbh > 0 and cbd > 0) or intensity < pow(0.010 * cbh * (460 + 25.9 * fmc), 1.5) then 'surface' when crown >= 3 / cbd then 'active' else 'passive' end as crown from i""")
def i20_fuelscape(spark, d):
    """Spread on flat ground and with wind and slope, intensity, flames and crown class of every cell."""
    c = F.col
    b = _blown(spark, d).withColumn("ros", c("base_ros") * (1 + c("factor")))
    flat = F.when(c("base_ros") > 0, B.spread(B.wind_factor(c("mph") * B.MPH * B.OPEN_SHARE))).otherwise(0.0)
    b = b.withColumns({"flat": flat, "intensity": F.coalesce(B.fireline_intensity(c("ros")), F.lit(0.0))})
    kind = fire.crown_class(c("intensity"), c("cbh"), c("fmc"), B.active_crown_spread(c("mph"), c("slope")), c("cbd"))
    crown = F.when(c("burns") & (c("cbh") > 0) & (c("cbd") > 0), kind).otherwise("surface")
    return b.select("p_partkey", F.round("flat", 6).alias("base_ros"), F.round("ros", 6).alias("slope_ros"), F.round("intensity", 4).alias("intensity"), F.round(fire.flame_length(c("intensity")), 6).alias("flame"), crown.alias("crown"))


@query("with " + _FUELS + " select p_partkey, coalesce(t.burnable, false) and p_partkey % 9 > 0 and p_partkey % 11 > 0 as crowns from part left join (select k, burnable from cured where c = 1) t on t.k = p_size")
def b27_crown_mask(spark, d):
    return cells(spark, d).select("p_partkey", B.has_crowns(F.col("cbh"), F.col("cbd"), F.col("fmc")).alias("crowns"))
