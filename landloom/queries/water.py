"""Balances, sentences, catalogues and small geometry over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import views as V
from landloom.functions import geo, labels, sentences
from landloom.operators import balance, layers, soil, spatial, telemetry

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""with s as (select c_nationkey as nation, avg(c_custkey % 700) as sampled, count(*) as n from customer group by 1),
  y as (select s_nationkey as nation, 2000 + s_suppkey as year, (s_suppkey % 900)::double as precip, (s_suppkey % 300)::double as aet, (s_suppkey % 200)::double as runoff, (s_suppkey % 100)::double as recharge from supplier),
  l as (select nation, unnest(max_by(y, year)) from y group by nation),
  a as (select coalesce(s.nation, l.nation)::bigint as nation, coalesce(n, 0) as n_samples, year::bigint as year, precip, coalesce(sampled, aet) as aet, runoff, recharge from s full join (select * exclude (nation_1) from l) l on s.nation = l.nation)
select nation, n_samples, year, precip as precip_mm, round(aet, 6) as aet_mm, runoff as runoff_mm, recharge as recharge_mm, round(precip * 360, 4) as precip_m3, round(aet * 360, 4) as aet_m3, round(runoff * 360, 4) as runoff_m3, round(recharge * 360, 4) as recharge_m3 from a""")
def e09_region_balance(spark, d):
    """The balance of 36 hectares in each nation."""
    k = F.col("s_suppkey").cast("long")
    samples = V.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), (F.col("c_custkey") % 700).alias("aet"))
    years = V.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), (k + 2000).alias("year"), *[(k % n).cast("double").alias(c) for c, n in (("precip_mm", 900), ("aet_mm", 300), ("runoff_mm", 200), ("recharge_mm", 100))])
    b = balance.region_balance(samples, years, "nation", F.lit(360_000.0))
    return b.select("nation", "n_samples", "year", "precip_mm", F.round("aet_mm", 6).alias("aet_mm"), "runoff_mm", "recharge_mm", *[F.round(c, 4).alias(c) for c in ("precip_m3", "aet_m3", "runoff_m3", "recharge_m3")])


@query("""with c as (select p_size as region, p_partkey as id, p_partkey * 31 % 997 as acc, case when p_partkey % 3 = 0 then p_partkey % 9 / 10.0::double end as depth, ['A','B','C','D'][p_partkey % 4 + 1] as hsg from part)
select region::bigint as region, count(*) * 0.01::double as footprint_ha, max(acc) * 0.01::double as contributing_ha, arg_min(id, [-acc, id])::bigint as outlet, round(coalesce(sum(depth), 0) * 100, 4) as storage_m3,
  round(count(*) filter (hsg = 'A') / count(*), 6) as share_a, round(count(*) filter (hsg = 'B') / count(*), 6) as share_b, round(count(*) filter (hsg = 'C') / count(*), 6) as share_c, round(count(*) filter (hsg = 'D') / count(*), 6) as share_d from c group by 1""")
def e23_drainage_summary(spark, d):
    k = F.col("p_partkey").cast("long")
    cells = V.table(spark, d, "part").select(F.col("p_size").cast("long").alias("region"), k.alias("id"), (k * 31 % 997).alias("acc"), F.when(k % 3 == 0, k % 9 / F.lit(10.0)).alias("depth"), F.element_at(F.array(*map(F.lit, "ABCD")), (k % 4 + 1).cast("int")).alias("hsg"))
    s = balance.drainage_summary(cells, "region", 100.0)
    return s.select("region", "footprint_ha", "contributing_ha", "outlet", F.round("storage_m3", 4).alias("storage_m3"), *[F.round(f"share_{g}", 6).alias(f"share_{g}") for g in "abcd"])


@query("""select p_partkey, least(greatest(case when p_partkey % 5 = 0 then p_size / 100.0::double end, 0.01), 0.99) as planned, round(case when p_partkey % 5 = 0 then least(greatest(p_size / 100.0::double, 0.01), 0.99) when p_partkey % 5 = 1 then least(greatest(p_size * 2 / 100.0::double, 0.05), 0.95)
  when p_partkey % 5 = 2 then least(greatest((p_size - 10) / 100.0::double, 0.05), 0.95) when p_partkey % 5 = 3 then least(greatest(p_size * 3 / 100.0::double, 0.05), 0.95) else 0.8 end, 8) as canopy from part""".replace("least(greatest(case when p_partkey % 5 = 0 then p_size / 100.0::double end, 0.01), 0.99) as planned, ", ""))
def j04_canopy_fraction(spark, d):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("double")
    return V.table(spark, d, "part").select("p_partkey", F.round(balance.canopy_fraction(F.when(k == 0, s), F.when(k == 1, s * 2), F.when(k == 2, s - 10), F.when(k == 3, s * 3)), 8).alias("canopy"))


@query("select p_partkey, round(p_retailprice * 4.5 / (select avg(p_retailprice) from part), 6) as v from part")
def j09_scenario_layer(spark, d):
    cells = V.table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    return balance.scenario_layer(cells, 4.5).select("p_partkey", F.round("v", 6).alias("v"))


@query("""with o as (select user_id as site, event_id, value * 2 as et0, (event_id % 50)::double as aet from events), l as (select site, max(event_id) as day from o group by 1)
select o.site, o.event_id as day, round(et0, 6) as et0_mm, aet as aet_mm, round(greatest(et0 - aet, 0), 6) as deficit_mm from o join l on o.site = l.site and o.event_id = l.day""")
def j10_latest_soil_water(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("day"), (F.col("value") * 2).alias("et0_mm"), (F.col("event_id") % 50).cast("double").alias("aet_mm"))
    return balance.latest_soil_water(e, "site").select("site", "day", F.round("et0_mm", 6).alias("et0_mm"), "aet_mm", F.round("deficit_mm", 6).alias("deficit_mm"))


@query("select s_suppkey, ((s_suppkey % 400 + 20) * (s_suppkey % 300 + 20) - (s_suppkey % 9) * (s_suppkey % 9))::double as area from supplier")
def j11_area_of_interest(spark, d):
    """The area of a rectangle without its square hole."""
    k = F.col("s_suppkey").cast("long")
    ring = lambda x0, y0, w, h: F.array(*[F.struct((x0 + w * i).cast("double").alias("x"), (y0 + h * j).cast("double").alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    rings = F.array(ring(F.lit(0), F.lit(0), k % 400 + 20, k % 300 + 20), ring(F.lit(5), F.lit(5), k % 9, k % 9))
    return V.table(spark, d, "supplier").select("s_suppkey", geo.polygon_area(rings).alias("area"))


@query("""select o_custkey, month(o_orderdate::date)::bigint as month, round(avg((o_orderkey % 120) / 10.0 * (4.87 / ln(672.58))), 6) as wind_2m, count(*) as days from orders group by 1, 2""")
def a17_monthly_wind(spark, d):
    daily = V.table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 120 / F.lit(10.0)).alias("speed"))
    return balance.monthly_wind(daily, "o_custkey").select("o_custkey", F.col("month").cast("long").alias("month"), F.round("wind_2m", 6).alias("wind_2m"), "days")


_SAID = sentences.TEXT
_M = "case when abs({0}) < 10 then printf('%.1f', {0}) else round_even({0}, 0)::bigint::varchar end || ' {1}'"


def _said(key: str, *parts: str) -> str:
    text = "'" + _SAID[key].replace("'", "''") + "'"
    for p in parts:
        text = text.replace("%s", f"' || {p} || '", 1)
    return text


_FLAT, _STEEP, _FLAME, _POWER = (_M.format(c, u) for c, u in (("flat", "m/min"), ("steep", "m/min"), ("flame", "m"), ("power", "kW/m")))


@query(f"""with p as (select p_partkey, p_partkey as k, case when k % 4 > 0 then p_type end as fuel, case when k % 3 > 0 then k % 137 / 7.0::double end as flat, case when k % 5 > 0 then k % 211 / 11.0::double end as steep, case when k % 7 > 0 then k % 1013 / 3.1::double end as arrival,
   240.0::double as duration, case when k % 2 > 0 then k % 97 / 7.0::double end as flame, case when k % 11 > 3 then k % 4001 / 13.0::double end as power, k % 4 as crown, k % 6 = 0 as ember from part)
select p_partkey, array_to_string(list_filter([case when fuel is not null then {_said("fuel", "fuel")} end,
  case when flat is not null and steep is not null then {_said("flat_and_slope", _FLAT.join("()"), _STEEP.join("()"))} when flat is not null then {_said("flat", _FLAT.join("()"))} when steep is not null then {_said("slope", _STEEP.join("()"))} end,
  case when arrival > duration then {_said("late", "'240'")} when arrival is not null then {_said("arrival", "(case when arrival < 90 then round_even(arrival, 0)::bigint::varchar || ' min' else printf('%.1f', arrival / 60) || ' hr' end)")} end,
  case when flame is not null and power is not null then {_said("flames_and_intensity", _FLAME.join("()"), _POWER.join("()"))} when flame is not null then {_said("flames", _FLAME.join("()"))} when power is not null then {_said("intensity", _POWER.join("()"))} end,
  case crown when 0 then {_said("crown_0")} when 1 then {_said("crown_1")} when 2 then {_said("crown_2")} end, case when ember then {_said("embers")} end], lambda s: s is not null), ' ') as said from p""")
def g32_fire_sentences(spark, d):
    k = F.col("p_partkey")
    some = lambda test, v: F.when(test, v)
    s = sentences.fire_sentences(
        some(k % 4 > 0, F.col("p_type")), some(k % 3 > 0, k % 137 / F.lit(7.0)), some(k % 5 > 0, k % 211 / F.lit(11.0)), some(k % 7 > 0, k % 1013 / F.lit(3.1)), F.lit(240.0),
        some(k % 2 > 0, k % 97 / F.lit(7.0)), some(k % 11 > 3, k % 4001 / F.lit(13.0)), k % 4, some(k % 6 == 0, F.lit(True)),
    )
    return V.table(spark, d, "part").select("p_partkey", F.array_join(s, " ").alias("said"))


_STOPS = [(10, 20, 30, 0), (90, 60, 200, 128), (255, 240, 10, 255)]


@query("""with t as (select p_partkey, greatest(least((p_partkey % 137) / 130.0::double - 0.02, 0.999999), 0.0) * 2 as x from part), u as (select p_partkey, floor(x)::int as i, x - floor(x) as f from t)
select p_partkey, array_to_string(list_transform([[10, 90, 255], [20, 60, 240], [30, 200, 10], [0, 128, 255]], lambda c: trunc(c[i + 1]::double + (c[i + 2] - c[i + 1]) * f)::int), ',') as color from u""")
def g28_color_ramp(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.array_join(labels.color_ramp((F.col("p_partkey") % 137) / F.lit(130.0) - 0.02, _STOPS).cast("array<string>"), ",").alias("color"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'name,' else '' end || 'brand' as shown from part")
def b18_visible_properties(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.lit(" "))
    props = F.create_map(F.lit("OBJECTID"), k.cast("string"), F.lit("name"), name, F.lit("brand"), F.col("p_brand"), F.lit("GlobalID"), F.col("p_type"), F.lit("note"), F.lit(""))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(F.map_keys(labels.visible_properties(props)), ",").alias("shown"))


@query(V.sql("entities") + ", t as (select entity_id, x, y from entities where entity_id = 'supplier:1') select t.entity_id as target_id, e.entity_id, round(sqrt(power(e.x - t.x, 2) + power(e.y - t.y, 2)), 6) as distance from t, entities e where e.entity_id <> t.entity_id and power(e.x - t.x, 2) + power(e.y - t.y, 2) <= 250000")
def c12_near_entity(spark, d):
    """What lies within 500 m of one named entity."""
    e = V.entities(spark, d)
    return spatial.near_entities(e, e.where("entity_id = 'supplier:1'"), 500.0).select("target_id", "entity_id", F.round("distance", 6).alias("distance"))


@query(V.sql("observations") + ", e as (select * replace (case when source = 's1' then null else source end as source) from observations), x as (select distinct entity_id, attr, value, observed_at, source from e where run_id < 15) select entity_id, count(*) as n from e where not exists (select 1 from x where x.entity_id = e.entity_id and x.attr = e.attr and x.value = e.value and x.observed_at = e.observed_at and x.source is not distinct from e.source) group by 1")
def c24_export_once(spark, d):
    """Observations that an export of the first days has not written; a source that is null on both sides is the same."""
    o = V.observations(spark, d).withColumn("source", F.when(F.col("source") != "s1", F.col("source"))).withColumn("observed_ms", F.unix_millis(F.col("observed_at").cast("timestamp")))
    return telemetry.unexported(o, o.where("run_id < 15")).groupBy("entity_id").agg(F.count("*").alias("n"))


@query("""with m as (select s_nationkey as k, min(s_name) as source from supplier group by 1), c as (select c_nationkey as k, count(*) as features from customer group by 1)
select n_name as layer, source, features, coalesce(features > 0, false) as ready from nation left join m on m.k = n_nationkey left join c on c.k = n_nationkey""")
def c07_catalogue(spark, d):
    name = V.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("layer"))
    manifest = V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("source")).join(name, "n_nationkey")
    stored = V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("features")).join(name, "n_nationkey")
    return layers.catalogue(name.select("layer"), manifest, stored)


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 3 else 2 end::bigint as n, round(s_suppkey / 7.0::double, 3) as x from supplier")
def d08_normal_path(spark, d):
    k = F.col("s_suppkey")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    first = k / F.lit(7.0)
    path = F.array(p(first, F.lit(1.0)), p(first + 0.00001, F.lit(1.00002)), p(first + 5, F.lit(2.0)), p(first + 5, F.when(k % 2 == 0, 3.0).otherwise(2.0)))
    n = geo.normal_path(path)
    return V.table(spark, d, "supplier").select("s_suppkey", F.size(n).cast("long").alias("n"), F.get(n, 0)["x"].alias("x"))


@query("select p_partkey, p_size <= 45 and p_partkey % 400 <= 180 as geographic from part")
def d18_geographic_extent(spark, d):
    k = F.col("p_partkey")
    box = F.struct(F.lit(-10.0).alias("min_x"), (k % 400).cast("double").alias("max_x"), F.lit(-5.0).alias("min_y"), (F.col("p_size") * 2).cast("double").alias("max_y"))
    return V.table(spark, d, "part").select("p_partkey", geo.is_geographic(box).alias("geographic"))


def seep_cells(spark, d):
    k = F.col("p_partkey").cast("long")
    return V.table(spark, d, "part").select(k.alias("id"), V.scene_x(k).alias("x"), V.scene_y(k).alias("y"), (k * 37 % 1009 / F.lit(10.0)).alias("score"))


@query()
def f10_seep_sites(spark, d):
    """The eight best seeps 30 m apart; held against the greedy loop in the tests."""
    return soil.seep_sites(seep_cells(spark, d))
