"""Fire, water, sun and telemetry operators over values taken from the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landloom import views as V
from landloom.functions import climate as C
from landloom.functions import fire, labels, sky
from landloom.operators import layers, raster, soil
from landloom.operators import telemetry as T

from .live import _EV, events

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _weather(spark, d):
    """``k, t_f, rh, days`` from parts."""
    k = F.col("p_partkey").cast("long")
    return V.table(spark, d, "part").select(k.alias("k"), (k % 60 + 40).cast("double").alias("t_f"), (F.col("p_size") * 2 % 97 + 2).cast("double").alias("rh"), (k % 21).cast("double").alias("days"))


_WEATHER = """w as (select p_partkey as k, (p_partkey % 60 + 40)::double as t, (p_size * 2 % 97 + 2)::double as rh, (p_partkey % 21)::double as days from part),
  e as (select *, case when rh < 10 then 0.03229 + 0.281073 * rh - 0.000578 * rh * t when rh < 50 then 2.22749 + 0.160107 * rh - 0.01478 * t else 21.0606 + 0.005565 * rh * rh - 0.00035 * rh * t - 0.483199 * rh end as e0 from w)"""


@query(f"""with {_WEATHER}, f as (select *, least(greatest(e0 - 1, 1), 100) as e1 from e)
select k, round(least(greatest(e1 + (35 - e1) * exp(-24 * days * 1.15), 2), 35) / 100, 9) as m1, round(least(greatest(e1 + 2 + (33 - e1) * exp(-24 * days * 1.15 / 10), 3), 35) / 100, 9) as m10,
  round(least(greatest(e1 + 4 + (26 - e1) * exp(-24 * days * 1.15 / 100), 4), 40) / 100, 9) as m100 from f""")
def i02_dead_moisture(spark, d):
    m = fire.dead_moisture(F.col("t_f"), F.col("rh"), F.col("days"), "mixed")
    return _weather(spark, d).select("k", *[F.round(c, 9).alias(n) for n, c in m.items()])


@query("select p_partkey, case when p_size / 50.0 > 0.5 then round(440 * (p_size / 50.0::double) - 190, 6) else 30 end::double as herb, case when p_size / 50.0 > 0.5 then round(280 * (p_size / 50.0::double) - 80, 6) else 60 end::double as woody from part")
def i04_live_moisture(spark, d):
    m = fire.live_moisture(F.col("p_size") / 50.0)
    return V.table(spark, d, "part").select("p_partkey", *[F.round(c, 6).alias(n) for n, c in m.items()])


@query("""with p as (select p_partkey, 35 + p_partkey % 20 as lat, 80 + p_partkey % 30 as lon, case when p_partkey % 4 = 0 then 0 else p_partkey % 2500 end as z, p_partkey % 365 + 1 as day from part),
  q as (select *, round_even(case when z > 0 then 142.1 * (lat / (43 + 33.7 * exp(-0.0351::double * (150 - lon)))) + 0.0172 * z else 151.0 * (lat / (46 + 23.4 * exp(-0.0360::double * (150 - lon)))) end, 0) as low from p),
  r as (select *, abs(day - low) as n from q)
select p_partkey, round(least(greatest(case when n < 30 then 85 + 0.0189 * n * n when n < 50 then 32.9 + 3.17 * n - 0.0288 * n * n else 120 end - 5, 80), 120), 6)::double as fmc from r""")
def i05_foliar_moisture(spark, d):
    k = F.col("p_partkey").cast("double")
    z = F.when(F.col("p_partkey") % 4 == 0, 0.0).otherwise(k % 2500)
    fmc = fire.foliar_moisture(35 + k % 20, 80 + k % 30, z, k % 365 + 1, "severe")
    return V.table(spark, d, "part").select("p_partkey", F.round(fmc, 6).alias("fmc"))


@query("""with p as (select p_partkey, (p_partkey % 40)::double as u, case when p_partkey % 11 = 0 then null when p_partkey % 2 = 0 then p_size * 2.0 else p_size / 50.0 end::double as c from part),
  q as (select *, least(greatest(coalesce(case when c > 1 then c / 100 else c end, 0), 0), 1) * 100 as pct from p)
select p_partkey, round(u * case when pct <= 5 then 0.4 when pct <= 10 then 0.3 when pct <= 15 then 0.25 when pct <= 30 then 0.2 when pct <= 50 then 0.15 else 0.1 end, 6) as wind from q""")
def i10_midflame_wind(spark, d):
    k = F.col("p_partkey")
    cover = F.when(k % 11 == 0, F.lit(None)).when(k % 2 == 0, F.col("p_size") * 2.0).otherwise(F.col("p_size") / 50.0)
    return V.table(spark, d, "part").select("p_partkey", F.round(fire.midflame_wind((k % 40).cast("double"), cover), 6).alias("wind"))


@query("""with p as (select p_partkey, p_retailprice / 100 as head, 1 + p_size / 8.0::double as lw from part), q as (select *, sqrt(greatest(1 - 1 / (lw * lw), 0)) as e from p)
select p_partkey, round(head * sqrt((1 - e) / (1 + e)), 6) as flank, round(head * (1 - e) / (1 + e), 6) as back from q""")
def i26_ellipse_rates(spark, d):
    m = fire.ellipse_rates(F.col("p_retailprice") / 100, 1 + F.col("p_size") / 8.0)
    return V.table(spark, d, "part").select("p_partkey", *[F.round(c, 6).alias(n) for n, c in m.items()])


@query("select p_partkey, round(18608 * (p_size / 50.0::double) * (p_retailprice / 500) / 60, 6) as intensity, round(0.0775 * pow(18608 * (p_size / 50.0::double) * (p_retailprice / 500) / 60, 0.46), 6) as flame from part")
def i14_flame_length(spark, d):
    i = fire.byram_intensity(F.lit(18608.0), F.col("p_size") / 50.0, F.col("p_retailprice") / 500)
    return V.table(spark, d, "part").select("p_partkey", F.round(i, 6).alias("intensity"), F.round(fire.flame_length(i), 6).alias("flame"))


@query(V.sql("terrain", "classes") + """, s as (select row, col, v = 3 and row % 64 between 5 and 30 and col between 20 and 30 as source, row % 64 between 3 and 32 and col between 18 and 32 as burned from classes),
  o as (select dr, dc from range(-13, 14) a(dr), range(-13, 14) b(dc) where (dr <> 0 or dc <> 0) and sqrt(dr*dr + dc*dc) * 10 <= 125 and abs((degrees(atan2(dc, -dr)) - 45 + 180 + 720) % 360 - 180) <= 22.5)
select distinct t.row, t.col from s t where not burned and exists (select 1 from s, o where s.source and s.row + dr = t.row and s.col + dc = t.col)""")
def i25_ember_band(spark, d):
    at = (F.col("row") % 64).between(5, 30) & F.col("col").between(20, 30)
    burned = (F.col("row") % 64).between(3, 32) & F.col("col").between(18, 32)
    cells = V.classes(spark, d).select("row", "col", ((F.col("v") == 3) & at).alias("source"), burned.alias("burned"))
    # a wind of 25 mph over flames of 1.5 m would reach 75 m, a passive crown fire further
    return layers.embers(cells, 10.0, 125.0, 45.0, 22.5)


@query("""with c as (select ['surface', 'passive', 'active'][p_partkey % 3 + 1] as class from part) select class, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 6) as fraction from c group by 1""")
def e24_crown_fractions(spark, d):
    c = V.table(spark, d, "part").select(F.element_at(F.array(F.lit("surface"), F.lit("passive"), F.lit("active")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("class"))
    n = c.groupBy("class").agg(F.count("*").alias("n"))
    return n.select("class", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("fraction"))


# --- water -------------------------------------------------------------------------------------------------


@query("select o_orderkey, case when o_custkey % 40 <= 3 then 3.5 when o_custkey % 40 <= 12 then 2.5 when o_custkey % 40 <= 24 then 2.0 else 1.5 end::double as factor from orders")
def g17_peaking_factor(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", soil.peaking_factor(F.col("o_custkey") % 40).alias("factor"))


@query("""with p as (select p_partkey, least(greatest(0.45 * (1 - p_size / 50.0::double) + 0.25 * (p_partkey % 10 / 10.0::double) + 0.2 * (p_partkey % 7 / 7.0::double) + 0.1 * (p_partkey % 5 / 5.0::double), 0), 1) as w from part)
select p_partkey, round(w, 6) as wetness, case when w < 0.33 then 'dry' when w > 0.67 then 'wet' else 'normal' end as class from p""")
def h16_antecedent(spark, d):
    k = F.col("p_partkey")
    w = C.clamp(C.antecedent(1 - F.col("p_size") / 50.0, k % 10 / 10.0, k % 7 / 7.0, k % 5 / 5.0), 0, 1)
    return V.table(spark, d, "part").select("p_partkey", F.round(w, 6).alias("wetness"), soil.antecedent_class(w).alias("class"))


@query("""with p as (select p_partkey, case p_partkey % 4 when 0 then null when 1 then 40 else 200 end as lim, case when p_partkey % 3 = 0 then null else 0.1 end as awc2 from part),
  q as (select *, greatest(least(coalesce(lim, 70), 70), 0) as deep from p),
  h as (select p_partkey, deep, unnest([0, 25]) as top, unnest([25, 120]) as bottom, unnest([0.2, awc2]) as awc from q where p_partkey % 5 > 0)
select p_partkey, round(sum((least(bottom, deep) - top) * awc * 10) filter (where awc is not null and least(bottom, deep) > top), 6)::double as taw from h group by 1
union all select p_partkey, round(12 * deep / 150.0 * 10, 6)::double from q where p_partkey % 5 = 0""")
def h08_root_zone_water(spark, d):
    k = F.col("p_partkey")
    h = lambda a, b, w: F.struct(F.lit(a).alias("top"), F.lit(b).alias("bottom"), w.cast("double").alias("awc"))
    horizons = F.when(k % 5 > 0, F.array(h(0.0, 25.0, F.lit(0.2)), h(25.0, 120.0, F.when(k % 3 != 0, 0.1))))
    limit = F.when(k % 4 == 1, 40.0).when(k % 4 > 1, 200.0)
    return V.table(spark, d, "part").select("p_partkey", F.round(soil.root_zone_water(horizons, 70.0, limit, F.lit(12.0)), 6).alias("taw"))


_RANK = "(row_number() over (order by {v}, row, col) - 1) / (count(*) over () - 1)::double"
_SLOPE = """g as (select row, col, z, (coalesce(lead(z) over a, z) - coalesce(lag(z) over a, z)) / 20 as dx, (coalesce(lead(z) over b, z) - coalesce(lag(z) over b, z)) / 20 as dy from terrain window a as (partition by row order by col), b as (partition by col order by row))"""


@query(V.sql("terrain") + f""", {_SLOPE}, s as (select row, col, z, round(degrees(atan(sqrt(dx*dx + dy*dy))), 9) as s, (row * 31 + col * 17) % 997 as acc from g),
  lines as (select row, max(col) as most from s group by 1), columns_ as (select col, max(row) as most from s group by 1),
  n as (select a.row, a.col, avg(b.s) as m from s a join lines l on l.row = a.row, range(-2, 3) o(i) join s b on b.row = a.row and b.col = least(greatest(a.col + i, 0), most) group by 1, 2),
  m as (select a.row, a.col, round(avg(b.m), 6) as m from n a join columns_ c on c.col = a.col, range(-2, 3) o(i) join n b on b.col = a.col and b.row = least(greatest(a.row + i, 0), most) group by 1, 2),
  k as (select s.row, s.col, acc, greatest(round(m - s, 6), 0) as brk, (s.row * 7 + s.col) % 200 as depth, (s.row + s.col) % 3 = 0 as unknown, (s.row + s.col) % 2 * 9.0 as ksat from s join m using (row, col)),
  p as (select *, {_RANK.format(v='acc')} as acc_pct, {_RANK.format(v='brk')} as brk_pct from k)
select row, col, round(40 * acc_pct + 20 * acc_pct + 15 * brk_pct + 25 * greatest(least(1 - coalesce(case when not unknown then depth when ksat < 5 then 60 end / 150.0::double, 1), 1), 0), 4) as score from p""")
def h06_seep_score(spark, d):
    """Ranks of flow and slope break with a shallow restriction; the flow stands in for wetness, too."""
    cells = V.terrain(spark, d).withColumnRenamed("z", "v")
    s = raster.slope(cells, 10.0).select("row", "col", F.round("slope", 9).alias("v"))
    m = raster.box_mean(s, 2).select("row", "col", F.round("v", 6).alias("m"))
    brk = s.join(m, ["row", "col"]).select("row", "col", F.greatest(F.round(F.col("m") - F.col("v"), 6), F.lit(0.0)).alias("v"))
    acc = cells.select("row", "col", ((F.col("row") * 31 + F.col("col") * 17) % 997).alias("v"))
    pct = lambda df, name: raster.percent_rank(df).withColumnRenamed("pct", name)
    both = pct(acc, "acc_pct").join(pct(brk, "brk_pct"), ["row", "col"])
    rc = F.col("row") + F.col("col")
    depth = F.when(rc % 3 != 0, ((F.col("row") * 7 + F.col("col")) % 200).cast("double"))
    score = soil.seep_score(F.col("acc_pct"), F.col("acc_pct"), F.col("brk_pct"), depth, (rc % 2) * 9.0)
    return both.select("row", "col", F.round(score, 4).alias("score"))


@query("""with c as (select p_brand as label, (p_size % 20)::double as v, (p_partkey % 4)::double as depth from part), k as (select label, sum(depth) * 100 as cap from c group by 1),
  g as (select label, cap, cap * ((hash_bucket % 5) + 1) / 5 as volume from (select label, cap, length(label) * 3 + (cap::bigint // 100) as hash_bucket from k)),
  lv as (select label, volume, cap, 0.0::double as lo, 40.0::double as hi from g where volume > 0),
  l as (select * from lv)
select label, round(level, 6) as level from (
  with recursive bi as (select label, volume, 0 as i, 0.0::double as lo, 40.0::double as hi from l
    union all select b.label, b.volume, b.i + 1, case when t.s < b.volume then (b.lo + b.hi) / 2 else b.lo end, case when t.s < b.volume then b.hi else (b.lo + b.hi) / 2 end
      from bi b join lateral (select sum(least(greatest((b.lo + b.hi) / 2 - c.v, 0), c.depth)) * 100 as s from c where c.label = b.label) t on true where b.i < 60)
  select label, (lo + hi) / 2 as level from bi where i = 60)""")
def h10_level_surface(spark, d):
    """Levels from running sums; the check finds them by halving."""
    c = V.table(spark, d, "part").select(F.col("p_brand").alias("label"), (F.col("p_size") % 20).cast("double").alias("v"), (F.col("p_partkey") % 4).cast("double").alias("depth"))
    cap = c.groupBy("label").agg((F.sum("depth") * 100).alias("cap"))
    volume = F.col("cap") * (((F.length("label") * 3 + F.floor(F.col("cap") / 100)) % 5) + 1) / 5
    return soil.level_surface(c, cap.select("label", volume.alias("volume")), 100.0).select("label", F.round("level", 6).alias("level"))


@query("""with c as (select event_id // 64 as row, event_id % 64 as col, (event_id % 100) / 99.0::double as p, case when event_id % 7 = 0 then null else (user_id % 150)::double end as taw from events),
  m as (select row, col, least(greatest(0.85 + 0.25 * p + 0.15 * least(greatest((coalesce(taw, 90.0) - 90) / 90, -0.5), 0.8), 0.65), 1.25) as m from c)
select row, col, round(480 * m / avg(m) over (), 6) as v from m""")
def j07_aet_layer(spark, d):
    i = F.col("event_id")
    cells = V.table(spark, d, "events").select(F.floor(i / 64).cast("long").alias("row"), (i % 64).alias("col"), (i % 100 / 99.0).alias("twi_pct"), F.when(i % 7 != 0, (F.col("user_id") % 150).cast("double")).alias("taw"))
    return layers.aet_layer(cells, 480.0, 90.0).select("row", "col", F.round("v", 6).alias("v"))


# --- sun ---------------------------------------------------------------------------------------------------

_CLEAR = """a as (select p_partkey as k, p_size * 1.7::double as alt, p_partkey % 365 + 1 as day from part),
  b as (select *, sin(radians(alt)) as cz, 1367 * (1 + 0.033 * cos(2 * pi() * day / 365)) as i0 from a),
  c as (select *, exp(-1700 / 8434.5::double) / (cz + 0.50572 * pow(96.07995 - (90 - alt), -1.6364)) as m from b),
  e as (select *, exp(-0.0903 * pow(m, 0.84) * (1 + m - pow(m, 1.01))) as tr, 1 - 0.1611 * (0.3 * m) * pow(1 + 139.48 * (0.3 * m), -0.3035) - 0.002715 * (0.3 * m) / (1 + 0.044 * (0.3 * m) + 0.0003 * (0.3 * m) * (0.3 * m)) as tz,
    exp(-0.0127 * pow(m, 0.26)) as tg, 1 - 2.4959 * (1.5 * m) / (pow(1 + 79.034 * (1.5 * m), 0.6828) + 6.385 * (1.5 * m)) as tw, exp(-pow(0.1::double, 0.873) * (1.1 - pow(0.1::double, 0.7088)) * pow(m, 0.9108)) as ta from c),
  f as (select *, 0.9662 * i0 * tr * tz * tg * tw * ta as dni, i0 * cz * tz * tg * tw * ((1 - tr) * 0.5 + tr * (1 - ta) * 0.75) as d0, 0.2 * (0.0685 + 0.16 * (1 - ta)) as r from e)"""


@query(f"with {_CLEAR} select k, round(dni, 5) as dni, round(d0 + (dni * cz + d0) * r / (1 - r), 5) as dhi, round(dni * cz + d0 + (dni * cz + d0) * r / (1 - r), 5) as ghi from f")
def k12_clear_sky(spark, d):
    alt, day = F.col("p_size") * 1.7, F.col("p_partkey") % 365 + 1
    m = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), sky.clear_sky(alt, 1700.0, day).alias("m"))
    return m.select("k", *[F.round(f"m.{n}", 5).alias(n) for n in ("dni", "dhi", "ghi")])


@query("""with s as (select s_suppkey as site, radians(-90 + id * 0.25::double) as dl, radians((s_suppkey % 60 + 1)::double) as phi from supplier, range(721) t(id)), v as (select site, 42164 * cos(dl) - 6371 * cos(phi) as x, 42164 * sin(dl) as y, -6371 * sin(phi) as z, phi from s),
  p as (select site, degrees(atan2(y, -sin(phi) * x + cos(phi) * z)) as az, degrees(atan2(cos(phi) * x + sin(phi) * z, sqrt(y * y + pow(-sin(phi) * x + cos(phi) * z, 2)))) as el from v)
select site, (round_even((case when az < 0 then az + 360 else az end) / 5, 0)::bigint % 72) * 5.0::double as azimuth, round(max(el), 6) as elevation from p group by 1, 2""")
def k07_satellite_belt(spark, d):
    """Highest geostationary elevation in each azimuth bin of five degrees, at the latitude of every site."""
    offset = F.explode(F.sequence(F.lit(0), F.lit(720))).alias("i")
    sites = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), offset)
    p = sites.select("site", sky.belt_position(F.col("site") % 60 + 1, -90 + F.col("i") * 0.25).alias("p"))
    az = (F.rint(F.col("p.azimuth") / 5).cast("long") % 72) * F.lit(5.0)
    return p.groupBy("site", az.alias("azimuth")).agg(F.round(F.max("p.elevation"), 6).alias("elevation"))


@query("select event_id, case when v >= 0 then 'day' when v >= -6 then 'civil_twilight' when v >= -12 then 'nautical_twilight' when v >= -18 then 'astronomical_twilight' else 'night' end as kind from (select event_id, event_id % 50 - 30 as v from events)")
def g23_twilight(spark, d):
    return V.table(spark, d, "events").select("event_id", sky.twilight(F.col("event_id") % 50 - 30).alias("kind"))


_PROFILE = "p as (select p_partkey, [(p_partkey * (i + 3) % 13)::double for i in range(8)] as prof, (p_size * 37 % 720 - 100)::double as az from part)"


@query(f"""with {_PROFILE}, q as (select *, ((az + 720) % 360) / 45 as pos from p)
select p_partkey, round(prof[floor(pos)::int % 8 + 1] + (prof[(floor(pos)::int + 1) % 8 + 1] - prof[floor(pos)::int % 8 + 1]) * (pos - floor(pos)), 6) as horizon,
  round(list_sum([pow(cos(radians(greatest(h, 0))), 2) for h in prof]) / 8, 9) as sky from q""")
def g19_horizon_profile(spark, d):
    """A site's horizon at an azimuth and the share of the sky it leaves."""
    k = F.col("p_partkey").cast("long")
    prof = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (k * (i + 3) % 13).cast("double"))
    p = V.table(spark, d, "part").select("p_partkey", prof.alias("prof"), (F.col("p_size") * 37 % 720 - 100).cast("double").alias("az"))
    return p.select("p_partkey", F.round(sky.horizon_at(F.col("prof"), F.col("az")), 6).alias("horizon"), F.round(sky.sky_view(F.col("prof")), 9).alias("sky"))


@query("select event_id, ((event_id * 37 % 720) - (event_id * 11 % 360) + 180 + 1440) % 360 - 180 as turn from events")
def g25_angle_between(spark, d):
    i = F.col("event_id")
    return V.table(spark, d, "events").select("event_id", labels.angle_between((i * 37 % 720).cast("double"), (i * 11 % 360).cast("double")).cast("long").alias("turn"))


# --- telemetry -----------------------------------------------------------------------------------------------


@query(f"""with {_EV}, f as (select *, lag(lon) over w as x0, lag(lat) over w as y0, lead(lon) over w as x1, lead(lat) over w as y1 from ev where lat is not null window w as (partition by device_id order by observed_ms, id)),
  g as (select id, coalesce(x1, lon) - coalesce(x0, lon) as dx, coalesce(y1, lat) - coalesce(y0, lat) as dy from f) select id, round(degrees(atan2(dx, dy)), 6) as heading from g where sqrt(dx*dx + dy*dy) >= 0.5""")
def l14_heading(spark, d):
    """Heading from the fix before to the fix after, where they are half a unit apart."""
    w = Window.partitionBy("device_id").orderBy("observed_ms", "id")
    around = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    f = events(spark, d).where("lat is not null").select("id", around("lon").alias("dx"), around("lat").alias("dy"))
    return f.where(F.hypot("dx", "dy") >= 0.5).select("id", F.round(F.degrees(F.atan2("dx", "dy")), 6).alias("heading"))


@query(f"with {_EV} select id from ev where device_id not in ('d1', 'd2') or gateway_id is distinct from 'g' || substr(device_id, 2)")
def l16_gateway_echo(spark, d):
    """Events but those that a gateway sends about itself: an anti-join with the registered gateways."""
    e = events(spark, d)
    own = spark.createDataFrame([("g1", "d1"), ("g2", "d2")], "gateway_id string, device_id string")
    return e.join(F.broadcast(own), ["gateway_id", "device_id"], "left_anti").select("id")


@query(f"with {_EV} select id, device_id from ev qualify row_number() over (order by id desc) <= 40")
def a41_tail(spark, d):
    """The last lines of a log."""
    return T.history(events(spark, d).withColumn("observed_ms", F.col("id")), limit=40).select("id", "device_id")


@query(V.sql("terrain") + """, ray as (select row, col, z, atan2(z - 1690 - 0, (col + 1) * 10) as a from terrain), m as (select *, max(a) over (partition by row order by col rows between unbounded preceding and 1 preceding) as before from ray)
select row, col, coalesce(a > before + 1e-7, true) as visible from m""")
def f05_running_horizon(spark, d):
    """Along each row of the grid, cells that stand above everything nearer."""
    a = F.atan2(F.col("z") - 1690, (F.col("col") + 1) * 10)
    nearer = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    t = V.terrain(spark, d).withColumn("a", a)
    return t.select("row", "col", F.coalesce(F.col("a") > F.max("a").over(nearer) + 1e-7, F.lit(True)).alias("visible"))
