"""Climate, water balance, fire and sky functions over small deterministic series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landloom import views as V
from landloom.functions import climate as C
from landloom.functions import fire, sky

QUERIES, ORACLES = {}, {}
LAT, ELEVATION = 40.0, 1700.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def days(spark, d):
    """A year of daily weather per nation: ``site, day, yday, prcp, tmin, tmax, tmean, rs, ea``."""
    k, i = F.col("n_nationkey").cast("long"), F.col("i")
    tmax = 25 - F.abs(i - 200) / F.lit(8.0) + (i * 7 + k) % 5
    tmin = tmax - 8 - (i * 3 + k) % 5
    base = V.table(spark, d, "nation").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(364).cast("long"))))
    return base.select(
        k.alias("site"), F.date_add(F.lit("2023-01-01").cast("date"), i.cast("int")).alias("day"), (i + 1).alias("yday"),
        F.greatest((i * 37 + k * 11) % 23 - 14, F.lit(0)).cast("double").alias("prcp"), tmin.alias("tmin"), tmax.alias("tmax"),
        ((tmin + tmax) / 2).alias("tmean"), (5 + (183 - F.abs(i - 172)) / F.lit(12.0)).alias("rs"), C.saturation_pressure(tmin).alias("ea"),
    )


_DAYS = """days0 as (select n_nationkey::bigint as site, i, 25 - abs(i - 200) / 8.0::double + (i * 7 + n_nationkey) % 5 as tmax, (i * 37 + n_nationkey * 11) % 23 - 14 as p from nation, range(365) r(i)),
  days1 as (select site, i, tmax, tmax - 8 - (i * 3 + site) % 5 as tmin, greatest(p, 0)::double as prcp, 5 + (183 - abs(i - 172)) / 12.0::double as rs from days0),
  days as (select site, date '2023-01-01' + i::int as day, i + 1 as yday, prcp, tmin, tmax, (tmin + tmax) / 2 as tmean, rs, 0.6108::double * exp(17.27::double * tmin / (tmin + 237.3::double)) as ea from days1)"""
_ET = (
    _DAYS
    + """, a as (select *, 1 + 0.033 * cos(2*pi()/365*yday) as dr, 0.409 * sin(2*pi()/365*yday - 1.39) as de, radians(40.0) as phi from days),
  b as (select *, acos(least(greatest(-tan(phi)*tan(de), -1), 1)) as ws from a),
  c as (select *, 1440/pi()*0.0820*dr*(ws*sin(phi)*sin(de) + cos(phi)*cos(de)*sin(ws)) as ra, 4098*(0.6108*exp(17.27*tmean/(tmean+237.3)))/power(tmean+237.3, 2) as delta,
    0.665e-3 * 101.3 * power((293-0.0065*1700)/293, 5.26) as gamma, (0.6108*exp(17.27*tmin/(tmin+237.3)) + 0.6108*exp(17.27*tmax/(tmax+237.3)))/2 as es from b),
  e as (select *, 0.77*rs - 4.903e-9*(power(tmax+273.16,4)+power(tmin+273.16,4))/2*(0.34-0.14*sqrt(ea))*(1.35*least(greatest(rs/((0.75+2e-5*1700)*ra),0.3),1)-0.35) as rn from c),
  et as (select *, greatest(ra/2.45*greatest(tmean+5,0)/100,0) as oudin, greatest(0.0023*0.408*ra*(tmean+17.8)*sqrt(tmax-tmin),0) as hargreaves,
    greatest(1.26*delta/(delta+gamma)*rn/2.45,0) as priestley_taylor, greatest((0.408*delta*rn + gamma*900/(tmean+273)*2*greatest(es-ea,0))/(delta+gamma*1.68),0) as penman_monteith from e)"""
)


@query("with " + _ET + """ select site, yday, round(oudin,6) as oudin, round(hargreaves,6) as hargreaves, round(priestley_taylor,6) as priestley_taylor,
  round(penman_monteith,6) as penman_monteith, round((oudin+hargreaves+priestley_taylor+penman_monteith)/4,6) as mean,
  round(greatest(oudin,hargreaves,priestley_taylor,penman_monteith)-least(oudin,hargreaves,priestley_taylor,penman_monteith),6) as spread from et""")
def j01_et0_ensemble(spark, d):
    e = C.et0(F.col("tmin"), F.col("tmax"), F.col("rs"), F.col("ea"), F.col("yday"), LAT, ELEVATION)
    return days(spark, d).select("site", "yday", *[F.round(v, 6).alias(k) for k, v in e.items()])


_KCB = "case when yday < 95 or yday > 315 then 0.25 when yday < 165 then 0.25 + 0.7*(yday-95)/70.0 when yday <= 260 then 0.95 else 0.25 + 0.7*(315-yday)/55.0 end"


@query(f"with {_DAYS} select distinct yday, round({_KCB}, 6)::double as kcb from days")
def j03_seasonal_kcb(spark, d):
    return days(spark, d).select("yday", F.round(C.kcb(F.col("yday")), 6).alias("kcb")).distinct()


_BUCKET = (
    "with recursive "
    + _ET
    + f""", w as (select site, yday, prcp, tmean, penman_monteith as et0, {_KCB} as kcb from et),
  f as (select site, 0::bigint as yday, 0::double as aet, 0::double as runoff, 0::double as recharge, 0::double as snow, 30::double as dr from (select distinct site from w)
   union all
   select s.site, s.yday, crop + held + sub, runoff, greatest(-(dr + crop - water), 0), pack - sub, least(greatest(dr + crop - water, 0), 100) from (
    select *, greatest(rain + melt - runoff - held, 0) as water, case when pack > 5 then 0 else least(greatest((100 - dr) / 50.0, 0), 1) * kcb * et0 end as crop from (
    select *, 0.04*greatest(rain+melt-8,0) + 0.18*greatest(rain+melt-35,0) as runoff, least(least(prcp, 0.6+1.6*0.8), et0*(0.10+0.15*0.8)) as held,
       case when pack > 5 then least(least(0.12*et0, 0.6), pack) else 0 end as sub from (
    select *, snow_in - melt as pack, case when tmean <= 0.5 then 0 else prcp end as rain from (
    select *, least(snow_in, case when tmean > 0 then 4*tmean else 0 end) as melt from (
    select w.site, w.yday, w.prcp, w.tmean, w.et0, w.kcb, f.dr, f.snow + case when w.tmean <= 0.5 then w.prcp else 0 end as snow_in from f join w on w.site = f.site and w.yday = f.yday + 1
    )))) ) s)
select site, yday, round(aet,5) as aet, round(runoff,5) as runoff, round(recharge,5) as recharge, round(snow,5) as snow, round(dr,5) as dr from f where yday > 0"""
)


@query(_BUCKET)
def j05_daily_bucket(spark, d):
    e = C.et0(F.col("tmin"), F.col("tmax"), F.col("rs"), F.col("ea"), F.col("yday"), LAT, ELEVATION)["penman_monteith"]
    b = C.bucket(days(spark, d).withColumn("et0", e), taw=100.0, canopy=0.8, start=(0.0, 30.0))
    r = lambda c: F.round(c, 5).alias(c)
    return b.select("site", F.dayofyear("day").cast("long").alias("yday"), *map(r, ("aet", "runoff", "recharge", "snow", "dr")))


@query(f"""with {_DAYS} select site, yday, round(least(sum(prcp) over (partition by site order by day rows 4 preceding)/25.0, 1), 6)::double as wetness_5d,
  round(least(sum(prcp) over (partition by site order by day rows 13 preceding)/60.0, 1), 6)::double as wetness_14d,
  round(least(sum(prcp) over (partition by site order by day rows 29 preceding)/110.0, 1), 6)::double as wetness_30d from days""")
def f04_trailing_wetness(spark, d):
    w = C.trailing_wetness(days(spark, d), water="prcp")
    return w.select("site", "yday", *[F.round(c, 6).alias(c) for c in ("wetness_5d", "wetness_14d", "wetness_30d")])


@query(f"with {_ET}, m as (select site, month(day) as month, penman_monteith as v from et) select site, coalesce(month, 0)::bigint as month, round(sum(v), 4) as et0 from m group by rollup (site, month) having site is not null")
def e12_annual_and_monthly_et0(spark, d):
    e = C.et0(F.col("tmin"), F.col("tmax"), F.col("rs"), F.col("ea"), F.col("yday"), LAT, ELEVATION)["penman_monteith"]
    m = days(spark, d).select("site", F.month("day").cast("long").alias("month"), e.alias("v"))
    return m.rollup("site", "month").agg(F.sum("v").alias("v")).where("site is not null").select("site", F.coalesce("month", F.lit(0).cast("long")).alias("month"), F.round("v", 4).alias("et0"))


@query(f"with {_ET}, y as (select site, sum(prcp) as p, sum(penman_monteith) as e from et group by 1) select site, round(e/p, 6) as aridity, round(least(greatest(1 + e/p - power(1 + power(e/p, 2.6), 1/2.6), 0), 1), 6) as share from y")
def e13_budyko(spark, d):
    e = C.et0(F.col("tmin"), F.col("tmax"), F.col("rs"), F.col("ea"), F.col("yday"), LAT, ELEVATION)["penman_monteith"]
    y = days(spark, d).groupBy("site").agg(F.sum("prcp").alias("p"), F.sum(e).alias("e"))
    return y.select("site", F.round(F.col("e") / F.col("p"), 6).alias("aridity"), F.round(C.budyko_fu(F.col("e") / F.col("p")), 6).alias("share"))


@query(f"""with {_DAYS}, w as (select site, year(day) + (month(day) >= 10)::int as wy, day, prcp from days),
  t as (select *, sum(prcp) over (partition by site, wy order by day rows 2 preceding) as p3 from w)
select site, wy::bigint as wy, max(prcp) as max_1d, max(p3) as max_3d, count(*) as n from t group by 1, 2""")
def a35_water_year_forcing(spark, d):
    w = days(spark, d).withColumn("wy", C.water_year(F.col("day")).cast("long"))
    p3 = F.sum("prcp").over(Window.partitionBy("site", "wy").orderBy("day").rowsBetween(-2, 0))
    return w.withColumn("p3", p3).groupBy("site", "wy").agg(F.max("prcp").alias("max_1d"), F.max("p3").alias("max_3d"), F.count("*").alias("n"))


@query(f"with {_DAYS} select site, round(corr(tmax, rs), 8) as r from days group by 1")
def a37_series_correlation(spark, d):
    return days(spark, d).groupBy("site").agg(F.round(F.corr("tmax", "rs"), 8).alias("r"))


@query("""with p as (select p_partkey, (p_size % 60 + 40)::double as t, (p_partkey % 97 + 2)::double as rh from part)
select p_partkey, round(case when rh < 10 then 0.03229+0.281073*rh-0.000578*rh*t when rh < 50 then 2.22749+0.160107*rh-0.01478*t else 21.0606+0.005565*rh*rh-0.00035*rh*t-0.483199*rh end, 6)::double as emc from p""")
def i01_equilibrium_moisture(spark, d):
    t, rh = (F.col("p_size") % 60 + 40).cast("double"), (F.col("p_partkey") % 97 + 2).cast("double")
    return V.table(spark, d, "part").select("p_partkey", F.round(fire.equilibrium_moisture(t, rh), 6).alias("emc"))


@query(f"""with {_DAYS} select site, yday, round(least(greatest((tmin + 2) / 7, 0), 1) * (1 - least(greatest((ea * 1000 - 900) / 3200, 0), 1)) * least(greatest(abs(rs) - 10, 0), 1), 6) as gsi from days""")
def i03_growing_season_index(spark, d):
    return days(spark, d).select("site", "yday", F.round(fire.growing_season_index(F.col("tmin"), F.col("ea") * 1000, F.abs("rs")), 6).alias("gsi"))


_BEDS = "beds as (select p_partkey, (p_size % 20 + 1) / 20.0::double as load, (p_partkey % 50 + 30) * 100.0::double as sav, (p_size % 10 + 2) / 10.0::double as depth, (p_partkey % 20 + 3) / 100.0::double as m, (p_partkey % 7)::double as u, (p_size % 5) / 10.0::double as sl from part)"


def beds(spark, d):
    c = F.col
    return V.table(spark, d, "part").select(
        "p_partkey", ((c("p_size") % 20 + 1) / F.lit(20.0)).alias("load"), ((c("p_partkey") % 50 + 30) * 100.0).alias("sav"), ((c("p_size") % 10 + 2) / F.lit(10.0)).alias("depth"),
        ((c("p_partkey") % 20 + 3) / F.lit(100.0)).alias("m"), (c("p_partkey") % 7).cast("double").alias("u"), ((c("p_size") % 5) / F.lit(10.0)).alias("sl"),
    )


_ROS = f"""with {_BEDS}, a as (select *, load*0.204816 as w0, sav*0.3048 as s, depth*3.28084 as dd, 18608*0.000429923 as h from beds),
  b as (select *, w0/dd as rho, w0/dd/32.0 as beta, 133.0*power(s,-0.7913) as aa, least(m/0.25,1) as rm from a),
  c as (select *, beta/(3.348*power(s,-0.8189)) as ratio from b),
  e as (select *, power(s,1.5)/(495+0.0594*power(s,1.5))*power(ratio,aa)*exp(aa*(1-ratio))*(w0*(1-0.0555))*h*greatest(1-2.59*rm+5.11*rm*rm-3.52*rm*rm*rm,0)*0.174*power(0.01,-0.19) as ir from c),
  g as (select *, exp((0.792+0.681*sqrt(s))*(beta+0.1))/(192+0.2595*s) as xi, 7.47*exp(-0.133*power(s,0.55))*power(least(u*196.85,0.9*ir),0.02526*power(s,0.54))*power(ratio,-0.715*exp(-3.59e-4*s)) as pw,
    5.275*power(beta,-0.3)*sl*sl as ps, rho*exp(-138/s)*(250+1116*m) as sink from e), ros as (select *, ir*xi*(1+pw+ps)/sink*0.3048 as ros from g)"""


@query(_ROS + " select p_partkey, round(ros, 5) as ros, round(0.0775 * power(18608 * load * ros / 60, 0.46), 5) as flame from ros")
def i13_rothermel(spark, d):
    ros = fire.rothermel(F.col("load"), F.col("sav"), F.col("depth"), F.lit(0.25), F.col("m"), F.col("u"), F.col("sl"))
    b = beds(spark, d).withColumn("ros", ros)
    return b.select("p_partkey", F.round("ros", 5).alias("ros"), F.round(fire.flame_length(fire.byram_intensity(F.lit(18608.0), F.col("load"), F.col("ros"))), 5).alias("flame"))


@query("""with p as (select p_partkey, p_retailprice * 3 as i, (p_size % 8)::double as cbh, (90 + p_partkey % 40)::double as fmc, (p_partkey % 30)::double as r, (p_size % 25 + 5) / 100.0 as cbd from part)
select case when i < power(0.010*cbh*(460+25.9*fmc),1.5) then 'surface' when r >= 3/cbd then 'active' else 'passive' end as class, count(*) as n from p group by 1""")
def i16_crown_class(spark, d):
    c = F.col
    k = fire.crown_class(c("p_retailprice") * 3, (c("p_size") % 8).cast("double"), (90 + c("p_partkey") % 40).cast("double"), (c("p_partkey") % 30).cast("double"), (c("p_size") % 25 + 5) / F.lit(100.0))
    return V.table(spark, d, "part").groupBy(k.alias("class")).agg(F.count("*").alias("n"))


@query("""with p as (select p_partkey, (p_size % 31)::double as u, radians((p_partkey % 360)::double) as th from part), r as (select *, least(greatest(0.936*exp(0.2566*u)+0.461*exp(-0.1548*u)-0.397,1),8) as lw from p),
  e as (select *, sqrt(1-1/(lw*lw)) as e from r) select p_partkey, round(lw,6) as ratio, round(10*(1-e)/(1-e*cos(th)),6) as spread from e""")
def i18_ellipse(spark, d):
    ratio = fire.ellipse_ratio((F.col("p_size") % 31).cast("double"))
    p = V.table(spark, d, "part").select("p_partkey", ratio.alias("ratio"), F.radians((F.col("p_partkey") % 360).cast("double")).alias("th"))
    return p.select("p_partkey", F.round("ratio", 6).alias("ratio"), F.round(fire.directional_spread(F.lit(10.0), F.col("ratio"), F.col("th")), 6).alias("spread"))


@query("""with p as (select p_partkey, p_partkey % 101 as twi, (p_size % 9) / 100.0 as pond, (p_partkey * 7) % 101 as seep, (p_size % 13) / 100.0 as flow from part),
  s as (select p_partkey, unnest([{'l': case when twi >= 95 then 3 when twi >= 90 then 2 when twi >= 75 then 1 else 0 end, 's': case when twi >= 95 then 1.0 when twi >= 90 then 0.8 when twi >= 75 then 0.55 else 0 end},
    {'l': case when pond >= 0.05 then 4 when pond > 0 then 3 else 0 end, 's': case when pond >= 0.05 then 1.0 when pond > 0 then 0.85 else 0 end},
    {'l': case when seep >= 80 then 3 when seep >= 60 then 2 else 0 end, 's': case when seep >= 80 then 1.0 when seep >= 60 then 0.8 else 0 end},
    {'l': case when flow >= 0.03 then 1 else 0 end, 's': case when flow >= 0.10 then 0.65 when flow >= 0.03 then 0.45 else 0 end}]) as g from p)
select p_partkey, max(g).l::bigint as level, max(g).s::double as score from s group by 1""")
def i23_hydro_influence(spark, d):
    c = F.col
    s = fire.hydro_level(c("p_partkey") % 101, (c("p_size") % 9) / F.lit(100.0), (c("p_partkey") * 7) % 101, (c("p_size") % 13) / F.lit(100.0))
    return V.table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", c("s.level").cast("long").alias("level"), c("s.score").alias("score"))


@query("""with t as (select o_orderkey, h::double as hour, radians(23.45*sin(radians(360.0/365.0*(284+dayofyear(o_orderdate))))) as de, radians(15.0*(h-12)) as ha, radians((o_custkey % 50 + 10)::double) as phi from orders, (values (6), (12), (18)) b(h))
select o_orderkey, hour, round(degrees(asin(least(greatest(sin(phi)*sin(de)+cos(phi)*cos(de)*cos(ha),-1),1))),5) as elevation,
  case when degrees(asin(sin(phi)*sin(de)+cos(phi)*cos(de)*cos(ha))) >= 0 then 'day' when degrees(asin(sin(phi)*sin(de)+cos(phi)*cos(de)*cos(ha))) >= -6 then 'civil_twilight'
  when degrees(asin(sin(phi)*sin(de)+cos(phi)*cos(de)*cos(ha))) >= -12 then 'nautical_twilight' when degrees(asin(sin(phi)*sin(de)+cos(phi)*cos(de)*cos(ha))) >= -18 then 'astronomical_twilight' else 'night' end as twilight from t""")
def k11_solar_position(spark, d):
    hours = F.explode(F.array(*map(F.lit, (6.0, 12.0, 18.0)))).alias("hour")
    t = V.table(spark, d, "orders").select("o_orderkey", F.dayofyear("o_orderdate").alias("yday"), (F.col("o_custkey") % 50 + 10).alias("lat"), hours)
    p = t.withColumn("p", sky.solar_position(F.col("lat"), F.col("yday"), F.col("hour")))
    return p.select("o_orderkey", "hour", F.round("p.elevation", 5).alias("elevation"), sky.twilight(F.col("p.elevation")).alias("twilight"))


@query("""with t as (select p_partkey, (p_partkey * 37 % 101) / 100.0::double as kt from part) select p_partkey, kt, round(case when kt <= 0.22 then 1-0.09*kt when kt <= 0.80 then 0.9511-0.1604*kt+4.388*kt*kt-16.638*kt*kt*kt+12.336*kt*kt*kt*kt else 0.165 end, 8)::double as diffuse from t""")
def g21_erbs(spark, d):
    kt = F.col("p_partkey") * 37 % 101 / F.lit(100.0)
    return V.table(spark, d, "part").select("p_partkey", kt.alias("kt"), F.round(sky.erbs_diffuse(kt), 8).alias("diffuse"))


@query("""with t as (select o_orderkey, (o_custkey % 100 + 1) * 500.0::double as m from orders) select o_orderkey, m, round((1-1/7.0::double)*m*m/(2*6371000.0), 8) as optical, round(0.75*m*m/(2*6371000.0), 8)::double as radio,
  round(17.3*sqrt((m/1000)*(60-m/1000)/(0.915*60)), 6) as fresnel from t""")
def g18_curvature_and_fresnel(spark, d):
    m = (F.col("o_custkey") % 100 + 1) * 500.0
    return V.table(spark, d, "orders").select("o_orderkey", m.alias("m"), F.round(sky.curvature_drop(m), 8).alias("optical"), F.round(sky.curvature_drop(m, "radio"), 8).alias("radio"), F.round(sky.fresnel_radius(m / 1000, 60 - m / 1000, 0.915), 6).alias("fresnel"))


@query(f"""with {_DAYS}, m as (select site, month(day)::bigint as month, avg(rs) as rs, avg(tmean) as t, avg((tmean <= 0)::int) as snow from days group by 1, 2)
select site, month, round(rs, 6) as rs, round(t, 6) as tmean, round(0.2 + 0.4 * snow, 6) as albedo from m""")
def e14_climate_normals(spark, d):
    m = days(spark, d).groupBy("site", F.month("day").cast("long").alias("month")).agg(F.avg("rs").alias("rs"), F.avg("tmean").alias("t"), F.avg((F.col("tmean") <= 0).cast("int")).alias("snow"))
    return m.select("site", "month", F.round("rs", 6).alias("rs"), F.round("t", 6).alias("tmean"), F.round(0.2 + 0.4 * F.col("snow"), 6).alias("albedo"))
