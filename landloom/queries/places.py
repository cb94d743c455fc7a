"""Points against grids and lines: voids, snapping, peaks, scattered stems, horizons; and store and plan look-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landloom import views as V
from landloom.functions import climate as C
from landloom.functions import fire, geo, sky
from landloom.operators import filters, raster, spatial, stems, store

from .layers import GRID
from .layers import stems as stem_rows
from .live import _EV, events

QUERIES, ORACLES = {}, {}
#: Tasks that the cells of one habitat code are dealt over.
SPREAD = 8
#: Species of a code that every cell takes in a row: as many as a run of packed numbers of a Parquet writer holds (63 groups of 8), so that its bytes repeat, too.
BLOCK = 504
#: Values of a column in a file: a writer's dictionary of 1 MB holds 131,072 longs, and partitions are not equal.
DISTINCT = 32_768


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CELLS = V.sql("terrain", "classes") + ", have as (select row, col, z as v from terrain join classes using (row, col) where v not in (3, 4) and not (row % 64 between 10 and 14 and col between 30 and 34)), gap as (select row, col from terrain except select row, col from have)"


@query(_CELLS + """, offs as (select dr, dc, sqrt(dr*dr + dc*dc) as d from range(-4, 5) a(dr), range(-4, 5) b(dc) where dr*dr + dc*dc between 1 and 16),
  k as (select gap.row, gap.col, h.v, o.d from gap, offs o, have h where h.row = gap.row + o.dr and h.col = gap.col + o.dc),
  m as (select row, col, sum(v / d) filter (where d <= 2) / sum(1 / d) filter (where d <= 2) as near, sum(v / d) / sum(1 / d) as far from k group by 1, 2)
select row, col, round(coalesce(near, far), 6) as v from m""")
def a31_void_fill(spark, d):
    t = V.terrain(spark, d).withColumnRenamed("z", "v")
    hole = (F.col("row") % 64).between(10, 14) & F.col("col").between(30, 34)
    have = t.join(V.classes(spark, d).where("v not in (3, 4)").select("row", "col"), ["row", "col"], "left_semi").where(~hole)
    gap = t.select("row", "col").join(have, ["row", "col"], "left_anti")
    return stems.fill_voids(have, gap, (2, 4)).select("row", "col", F.round("v", 6).alias("v"))


_P = "p as (select p_partkey, (p_partkey * 53 % 640 - 320)::double as x, (p_partkey * 29 % 640 - 320)::double as y from part)"


def _points(spark, d):
    return stem_rows(spark, d).select(F.col("k").alias("p_partkey"), "x", "y")


@query(V.sql("terrain", "classes") + f""", {_P}, a as (select *, floor((320 - y) / 10)::bigint as row, floor((x + 320) / 10)::bigint as col from p)
select p_partkey from a join classes c using (row, col) where abs(x) < 300 and abs(y) < 300 and not (x > -100 and x < 100 and y > -100 and y < 100) and c.v <> 4 and not (x = -100 and y >= -100 and y < 100) and not (y = -100 and x >= -100 and x < 100)""")
def b22_area_validity(spark, d):
    """Points on a finite cell and inside the area of interest, holes honoured."""
    corner = lambda r: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-r, -r), (r, -r), (r, r), (-r, r), (-r, -r))])
    cells = V.classes(spark, d).select("row", "col", F.when(F.col("v") != 4, F.col("v")).alias("v"))
    at = raster.sample(_points(spark, d), cells, GRID).where("v is not null and abs(x) < 300 and abs(y) < 300")
    return at.where(geo.in_polygon_with_holes(F.col("x"), F.col("y"), F.array(corner(300), corner(100)))).select("p_partkey")


@query(f"with {_EV} select device_id, count(*) as n from ev where kind <> 'junk' and gateway_id in ('g0', 'g2') and device_id not in ('d4', 'd8') group by 1")
def b25_visible_devices(spark, d):
    """Events of configured gateways, without hidden devices."""
    e = events(spark, d).where("kind <> 'junk'")
    known = spark.createDataFrame([("g0",), ("g2",)], "gateway_id string")
    hidden = spark.createDataFrame([("d4",), ("d8",)], "device_id string")
    return e.join(F.broadcast(known), "gateway_id", "left_semi").join(F.broadcast(hidden), "device_id", "left_anti").groupBy("device_id").agg(F.count("*").alias("n"))


@query(V.sql("segments") + """, pr as (select a.stream_id as one, b.stream_id as other, a.x1 as ax, a.y1 as ay, a.x2 as bx, a.y2 as by_, b.x1 as cx, b.y1 as cy, b.x2 as dx, b.y2 as dy from segments a, segments b where a.stream_id < b.stream_id),
  o as (select *, sign((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)) as o1, sign((bx-ax)*(dy-ay)-(by_-ay)*(dx-ax)) as o2, sign((dx-cx)*(ay-cy)-(dy-cy)*(ax-cx)) as o3, sign((dx-cx)*(by_-cy)-(dy-cy)*(bx-cx)) as o4 from pr)
select one, other from o group by 1, 2 having bool_or(o1 * o2 < 0 and o3 * o4 < 0)""")
def c11_crossing_paths(spark, d):
    """Pairs of polylines that cross: distance 0."""
    return spatial.crossings(V.streams(spark, d), "stream_id")


@query(V.sql("terrain", "classes") + f""", {_P}, c as (select row, col, -320 + (col + 0.5) * 10.0::double as cx, 320 - (row + 0.5) * 10.0::double as cy from classes where v = 4),
  m as (select p_partkey, row, col, (x-cx)*(x-cx)+(y-cy)*(y-cy) as d2 from p, c where (x-cx)*(x-cx)+(y-cy)*(y-cy) <= 900)
select p_partkey, arg_min(row, (d2, row, col)) as row, arg_min(col, (d2, row, col)) as col from m group by 1""")
def c14_snap_to_cell(spark, d):
    return stems.snap(_points(spark, d), V.classes(spark, d).where("v = 4"), GRID, "p_partkey", 30.0)


@query(V.sql("terrain") + f""", {_P}, c as (select row, col, z, -320 + (col + 0.5) * 10.0::double as cx, 320 - (row + 0.5) * 10.0::double as cy from terrain),
  m as (select p_partkey, row, col, z from p, c where (x-cx)*(x-cx)+(y-cy)*(y-cy) <= 1600)
select p_partkey, arg_max(row, (z, -row, -col)) as row, arg_max(col, (z, -row, -col)) as col, max(z) as v from m group by 1""")
def h22_highest_near(spark, d):
    return stems.highest_near(_points(spark, d), V.terrain(spark, d).withColumnRenamed("z", "v"), GRID, "p_partkey", 40.0)


@query(V.sql("segments") + """, s as (select stream_id, x1, y1, x2, y2, greatest(ceil(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) / 5), 1)::int as n from segments),
  p as (select stream_id, x1 + (x2 - x1) * i / n as x, y1 + (y2 - y1) * i / n as y from s, lateral (select unnest(range(0, n + 1)) as i) r)
select distinct stream_id, floor((320 - y) / 10)::bigint as row, floor((x + 320) / 10)::bigint as col from p where floor((320 - y) / 10) between 0 and 63 and floor((x + 320) / 10) between 0 and 63""")
def d14_line_cells(spark, d):
    return stems.line_cells(V.streams(spark, d), GRID, "stream_id")


@query(V.sql("terrain") + f""", {_P}, dabs as (select x, y, sum(p_partkey % 3 + 1) as strength from p group by 1, 2),
  c as (select row, col, -320 + (col + 0.5) * 10.0::double as cx, 320 - (row + 0.5) * 10.0::double as cy from terrain),
  t as (select row, col, strength, 1 - sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) / 35 as t from dabs, c where (x-cx)*(x-cx)+(y-cy)*(y-cy) <= 1225)
select row, col, round(sum(strength * t * t * (3 - 2 * t)), 6) as weight from t group by 1, 2""")
def h27_stamps(spark, d):
    dabs = _points(spark, d).select("x", "y", (F.col("p_partkey") % 3 + 1).alias("strength"))
    return stems.stamps(V.terrain(spark, d), dabs, GRID, 35.0).select("row", "col", F.round("weight", 6).alias("weight"))


_U = "('0x' || substr(sha1('fill|{a}|' || ix || '|' || iy), 1, 12))::hugeint / 281474976710655.0::double"
_SCATTER = f"""deep as (select max(event_id) // 64 + 1 as n from events),
  sc as (select ix, iy, -320 + (ix + {_U.format(a='x')}) * 20.0::double as x, 320 - 10 * n + (iy + {_U.format(a='y')}) * 20.0::double as y from range(32) a(ix), deep, (select unnest(range(0, (select n // 2 from deep))) as iy))"""


def _candidates(spark, d):
    """One place in each square of 20 m of the terrain."""
    return stems.scattered(raster.Grid(GRID.x0, GRID.y0, GRID.size, 64, V.terrain_rows(spark, d)), spark, 20.0, "fill")


@query(f"with {_SCATTER} select ix, iy, round(x, 6) as x, round(y, 6) as y from sc")
def m04_scattered_candidates(spark, d):
    return _candidates(spark, d).select("ix", "iy", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"with {_SCATTER}, {_P} select ix, iy from sc where not exists (select 1 from p where (p.x-sc.x)*(p.x-sc.x)+(p.y-sc.y)*(p.y-sc.y) < 144)")
def m05_densify(spark, d):
    """Candidates that keep their distance from the stems there are."""
    c = _candidates(spark, d).withColumn("c", F.col("ix") + F.col("iy") * 1000)
    return stems.apart(c, _points(spark, d).select(F.col("x").alias("rx"), F.col("y").alias("ry")), 12.0, "c").select("ix", "iy")


@query("select p_partkey, 'part:' || p_size || case when row_number() over w > 1 then '-' || row_number() over w else '' end as entity_id from part window w as (partition by p_size order by p_partkey)")
def m06_numbered_ids(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", "p_size")
    return stems.numbered_ids(p, F.concat(F.lit("part:"), F.col("p_size").cast("string")), "p_partkey").select("p_partkey", "entity_id")


@query(V.sql("observations", "lifecycle") + """, latest as (select entity_id, attr, arg_max(value, obs_id) as value from observations group by all)
select l.entity_id, max(value) filter (where attr = 'view') as view, max(value) filter (where attr = 'click') as click, max(value) filter (where attr = 'signup') as signup
from lifecycle l left join latest a using (entity_id) where retired_run_id is null group by 1""")
def m12_population(spark, d):
    """Live members with their attributes as columns."""
    alive = store.alive(V.lifecycle(spark, d)).select("entity_id")
    return alive.join(store.wide(V.observations(spark, d), ["view", "click", "signup"]), "entity_id", "left")


@query(V.sql("observations", "lifecycle") + """, seen as (select distinct entity_id from observations where run_id >= 20)
select l.entity_id, case when retired_run_id is null then 'kept' else 'unretired' end as change from lifecycle l join seen using (entity_id)
union all select entity_id, 'created' from (select 'customer:' || c_custkey as entity_id from customer) n where entity_id not in (select entity_id from lifecycle)""")
def n02_upsert_entities(spark, d):
    """What staged ids do to the store: keep, un-retire or create."""
    staged = V.observations(spark, d).where("run_id >= 20").select("entity_id").distinct()
    new = V.table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit(True).alias("extra"))
    known = V.lifecycle(spark, d).select("entity_id", "retired_run_id", F.lit(True).alias("known"))
    both = staged.withColumn("extra", F.lit(False)).union(new).join(known, "entity_id", "left").where("not extra or known is null")
    change = F.when(F.col("known").isNull(), "created").when(F.col("retired_run_id").isNull(), "kept").otherwise("unretired")
    return both.select("entity_id", change.alias("change"))


@query("""with r as (select o_custkey as plan, o_orderkey as run, o_orderdate, case o_orderstatus when 'F' then 'failed' when 'O' then 'complete' else 'running' end as status from orders)
select plan, arg_max(status, (o_orderdate, run)) as status, count(*) as runs, count(*) filter (where status = 'failed') as failed from r group by 1""")
def n14_simulation_status(spark, d):
    o = V.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "complete").otherwise("running")
    return o.groupBy(F.col("o_custkey").alias("plan")).agg(F.max_by(status, F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count("*").alias("runs"), F.count_if(status == "failed").alias("failed"))


@query(f"""with stems as (select p_partkey as k, (p_partkey * 53 % 640 - 320)::double as rx, (p_partkey * 29 % 640 - 320)::double as ry, (p_size % 20 + 1)::double as height, (p_partkey % 25 + 1)::double as radius from part),
  site as (select s_suppkey, (s_suppkey * 41 % 500 - 250 + 0.5)::double as x, (s_suppkey * 67 % 500 - 250 + 0.5)::double as y from supplier),
  m as (select s_suppkey, height, radius, sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)) as d, degrees(atan2(rx-x, ry-y)) as mid from site, stems where (x-rx)*(x-rx)+(y-ry)*(y-ry) <= 6400),
  n as (select *, floor((mid - degrees(atan2(radius, d))) / 5 + 0.5)::int as a, floor((mid + degrees(atan2(radius, d))) / 5 + 0.5)::int as b from m),
  u as (select s_suppkey, degrees(atan2(height, d)) as deg, unnest(range(a, b + 1)) as k from n)
select s_suppkey, ((k + 144) % 72)::int as bin, round(max(deg), 6) as deg from u group by 1, 2""")
def k16_lifted_horizon(spark, d):
    k = F.col("s_suppkey").cast("long")
    site = V.table(spark, d, "supplier").select("s_suppkey", (k * 41 % 500 - 250 + 0.5).cast("double").alias("x"), (k * 67 % 500 - 250 + 0.5).cast("double").alias("y"))
    s = stem_rows(spark, d).select(F.col("x").alias("rx"), F.col("y").alias("ry"), "height", "radius")
    return stems.lifted_horizon(site, s, "s_suppkey", 80.0).select("s_suppkey", "bin", F.round("deg", 6).alias("deg"))


@query(f"""with {_P}, st as (select p_partkey as k, x as rx, y as ry, (p_partkey % 25 + 1)::double as radius from p), site as (select s_suppkey, (s_suppkey * 41 % 500 - 250)::double as x, (s_suppkey * 67 % 500 - 250)::double as y from supplier)
select s_suppkey, count(*) filter (where sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)) <= 4.6 + radius) as conflicts from site, st where (x-rx)*(x-rx)+(y-ry)*(y-ry) <= 900 group by 1""")
def k15_crown_conflicts(spark, d):
    """Crowns that reach into a footprint of 4.6 m around each site, of the stems within 30 m."""
    k = F.col("s_suppkey").cast("long")
    site = V.table(spark, d, "supplier").select("s_suppkey", (k * 41 % 500 - 250).cast("double").alias("x"), (k * 67 % 500 - 250).cast("double").alias("y"))
    return stems.crown_conflicts(site, stem_rows(spark, d).select(F.col("x").alias("rx"), F.col("y").alias("ry"), "radius"), "s_suppkey", 4.6, 30.0)


@query("select o_orderkey, round(greatest(sin(radians(e)) * cos(radians(t)) + cos(radians(e)) * sin(radians(t)) * cos(radians(a - f)), 0), 9) as cosine from (select o_orderkey, o_orderkey % 90 as e, o_custkey % 360 as a, o_orderkey % 60 as t, o_custkey * 7 % 360 as f from orders)")
def g22_incidence(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return V.table(spark, d, "orders").select("o_orderkey", F.round(sky.incidence_cosine(k % 90, c % 360, k % 60, c * 7 % 360), 9).alias("cosine"))


@query("""with p as (select o_orderkey, dayofyear(o_orderdate) as yday, o_custkey % 50 + 10 as lat from orders), q as (select o_orderkey, 1 + 0.033 * cos(2 * pi() / 365 * yday) as dr, 0.409 * sin(2 * pi() / 365 * yday - 1.39) as dec, radians(lat::double) as phi from p),
  r as (select *, acos(least(greatest(-tan(phi) * tan(dec), -1), 1)) as ws from q)
select o_orderkey, round(24 * 60 / pi() * 0.0820 * dr * (ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws)), 8) as ra, round(24 / pi() * ws, 8) as hours from r""")
def g12_extraterrestrial(spark, d):
    day, lat = F.dayofyear("o_orderdate"), F.col("o_custkey") % 50 + 10
    return V.table(spark, d, "orders").select("o_orderkey", F.round(C.extraterrestrial(lat, day), 8).alias("ra"), F.round(C.day_length(lat, day), 8).alias("hours"))


@query("""with p as (select p_partkey, ['normal_spring', 'high_spring', 'extreme_redflag', 'summer_drought', 'dormant_fall'][p_partkey % 5 + 1] as class, case when p_partkey % 3 = 0 then p_size * 4.0 - 40 end as temp, case when p_partkey % 4 = 0 then p_size * 5.0 end as wind from part),
  d(class, t, rh, w) as (values ('normal_spring', 60, 45, 8), ('high_spring', 68, 30, 15), ('extreme_redflag', 78, 15, 25), ('summer_drought', 85, 25, 18), ('dormant_fall', 55, 30, 12))
select p_partkey, least(greatest(coalesce(temp, t), -20), 130)::double as temp_f, rh::double as rh, least(greatest(coalesce(wind, w), 0), 120)::double as wind_mph from p join d using (class)""")
def i28_weather_presets(spark, d):
    """A preset's weather with overrides where given, kept in range."""
    k = F.col("p_partkey")
    presets = spark.createDataFrame([(n, float(t), float(h), float(w)) for n, (t, h, w, *_) in fire.PRESETS.items()], "class string, t double, rh double, w double")
    p = V.table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, fire.PRESETS)), (k % 5 + 1).cast("int")).alias("class"), F.when(k % 3 == 0, F.col("p_size") * 4.0 - 40).alias("temp"), F.when(k % 4 == 0, F.col("p_size") * 5.0).alias("wind"))
    j = p.join(F.broadcast(presets), "class")
    return j.select("p_partkey", C.clamp(F.coalesce("temp", "t"), -20, 130).alias("temp_f"), "rh", C.clamp(F.coalesce("wind", "w"), 0, 120).alias("wind_mph"))


@query("""with b as (select p_partkey as species, p_partkey % 2048 as code from part), c as (select event_id // 64 as row, event_id % 64 as col, user_id % 2048 as code from events)
select row, col, species from c join b using (code)""")
def h24_species_at_cell(spark, d):
    """Species whose habitat code a cell carries, one row each.

    The result is the product of both sides of every code. It is joined by code and written block by block: every cell of a code with BLOCK of its
    species, again and again in one order. Runs of a cell and a short cycle of species take an eighth of a byte a row, as long as the writer keeps to its
    dictionaries, so partitions are as many as leave each about DISTINCT values. Cells of one code are dealt over SPREAD tasks, with a copy of its species each.
    """
    i = F.col("event_id")
    code = lambda c: (F.col(c) % 2048).alias("code")
    events, part = (V.table(spark, d, n).where(F.col(c).isNotNull()) for n, c in (("events", "user_id"), ("part", "p_partkey")))
    cells = events.select(F.floor(i / 64).cast("long").alias("row"), (i % 64).alias("col"), code("user_id"), F.pmod(F.xxhash64(i), F.lit(SPREAD)).alias("part"))
    number = F.row_number().over(Window.partitionBy("code").orderBy("species")) - 1
    blocks = part.select(F.col("p_partkey").alias("species"), code("p_partkey")).withColumn("block", F.floor(number / BLOCK)).groupBy("code", "block").agg(F.sort_array(F.collect_list("species")).alias("species"))
    blocks = blocks.select("code", "species", F.explode(F.array([F.lit(k).cast("long") for k in range(SPREAD)])).alias("part"))
    # a count of partitions that is asked for is not lowered by their size, which says little of their product
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(events.count(), part.count() * SPREAD) // DISTINCT))
    blocks, cells = (x.repartition(n, "code", "part") for x in (blocks, cells))
    # a merge join goes through the cells for each row of its left side
    return blocks.join(cells.hint("merge"), ["code", "part"]).select("row", "col", F.explode("species").alias("species"))


@query(V.sql("entities") + " select kind, count(*) as n, round(min(x), 3) as min_x, round(max(y), 3) as max_y from entities group by grouping sets ((kind), ())")
def e00_grouping_sets(spark, d):
    """Totals beside groups in one pass."""
    return V.entities(spark, d).rollup("kind").agg(F.count("*").alias("n"), F.round(F.min("x"), 3).alias("min_x"), F.round(F.max("y"), 3).alias("max_y"))


@query("""select p_partkey, case when p_size > 40 then 'A' when p_size > 25 then 'B' else 'C' end as band, round(p_retailprice - lag(p_retailprice) over (partition by p_brand order by p_partkey), 4) as delta from part""")
def f03_delta(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    band = F.when(F.col("p_size") > 40, "A").when(F.col("p_size") > 25, "B").otherwise("C")
    return V.table(spark, d, "part").select("p_partkey", band.alias("band"), F.round(F.col("p_retailprice") - F.lag("p_retailprice").over(w), 4).alias("delta"))


@query(V.sql("entities") + " select entity_id, kind, nation from entities where entity_id = 'customer:7'")
def n05_get_entity(spark, d):
    r = filters.parse_filter("entity_id = 'customer:7'")
    return V.entities(spark, d).where(r.on(F.col("entity_id"))).select("entity_id", "kind", "nation")
