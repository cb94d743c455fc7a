"""Raster operators on the terrain of the events: a strip of 64 cells of 10 m, integer heights."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import views as V
from landloom.operators import raster as R
from landloom.operators import sight

QUERIES, ORACLES = {}, {}
GRID = R.Grid(x0=-320.0, y0=320.0, size=10.0, width=64, height=64)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _dem(spark, d):
    return V.terrain(spark, d).withColumnRenamed("z", "v")


_OFF = "(values (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)) o(k,dr,dc)"
_D8 = V.sql("entities", "terrain") + f""", pairs as (
  select t.row, t.col, o.k, (t.z - n.z) / case when o.k in (0,2,5,7) then 10 * sqrt(2.0) else 10 end as s
  from terrain t, {_OFF} join terrain n on n.row = t.row + o.dr and n.col = t.col + o.dc),
  d8 as (select t.row, t.col, coalesce(b.k, -1) as k from terrain t left join
    (select row, col, arg_max(k, (s, -k)) as k from pairs where s > 0 group by 1, 2) b on b.row = t.row and b.col = t.col)"""


@query(V.sql("entities", "terrain") + " select e.entity_id, t.z as v from entities e join terrain t on t.row = floor((320 - y) / 10) and t.col = floor((x + 320) / 10)")
def c15_raster_at_point(spark, d):
    return R.sample(V.entities(spark, d).select("entity_id", "x", "y"), _dem(spark, d), GRID, "inner").select("entity_id", "v")


@query(V.sql("entities", "terrain") + """, p as (select entity_id, (x + 320) / 10 - 0.5 as u, (320 - y) / 10 - 0.5 as t from entities),
  k as (select entity_id, floor(t) + dr as row, floor(u) + dc as col, (case dc when 1 then u - floor(u) else 1 - (u - floor(u)) end) * (case dr when 1 then t - floor(t) else 1 - (t - floor(t)) end) as w
    from p, (values (0,0),(0,1),(1,0),(1,1)) o(dr,dc))
select entity_id, round(sum(z * w) / sum(w), 6) as v from k join terrain using (row, col) where w > 0 group by 1""")
def c16_bilinear(spark, d):
    return R.bilinear(V.entities(spark, d), _dem(spark, d), GRID, "entity_id").select("entity_id", F.round("v", 6).alias("v"))


@query(V.sql("terrain") + " select row, col, case when (row + col) % 3 = 0 then -1 else z end::double as v from terrain")
def c18_overlay(spark, d):
    top = V.terrain(spark, d).select("row", "col", F.when((F.col("row") + F.col("col")) % 3 == 0, F.lit(-1.0)).alias("v"))
    return R.overlay(_dem(spark, d), top)


@query(V.sql("terrain") + """, t as (select row, col from (select unnest(range(0, (select (max(row) + 1) // 3 from terrain))) as row), range(21) c(col))
select t.row, t.col, s.z as v from t join terrain s on s.row = floor((320 - (300 - (t.row + 0.5) * 30)) / 10) and s.col = floor((-300 + (t.col + 0.5) * 30 + 320) / 10)""")
def c19_resample(spark, d):
    return R.resample(_dem(spark, d), GRID, R.Grid(-300.0, 300.0, 30.0, 21, V.terrain_rows(spark, d) // 3))


@query(V.sql("edges") + """, cell as (select id // 40 as row, id % 40 as col, -2000 + (id % 40 + 0.5) * 100 as x, 2000 - (id // 40 + 0.5) * 100 as y from range(1600) r(id)),
  hit as (select c.row, c.col, e.parcel_id, sum(case when (y2 > y) <> (y1 > y) and x < (x2-x1)*(y-y1)/nullif(y2-y1, 0) + x1 then 1 else 0 end) as n from cell c, edges e group by 1, 2, 3)
select row, col, max(parcel_id) as v from hit where n % 2 = 1 group by 1, 2""")
def d11_rasterise(spark, d):
    return R.rasterise(V.parcels(spark, d), R.Grid(-2000.0, 2000.0, 100.0, 40, 40), "parcel_id", "parcel_id")


@query(V.sql("terrain", "classes") + """, s as (select v, count(*) as n from classes where row >= 10 and col between 5 and 50 group by 1)
select v, n, round(n / sum(n) over (), 6) as share from s""")
def e05_zonal_share(spark, d):
    z = R.zonal(V.classes(spark, d), (F.col("row") >= 10) & F.col("col").between(5, 50))
    return z.select("v", "n", F.round("share", 6).alias("share"))


@query(V.sql("terrain") + " select min(z) as least, max(z) as most, round(avg(z), 6) as mean, count(*) as n from terrain")
def e07_layer_summary(spark, d):
    return _dem(spark, d).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


@query(V.sql("terrain") + " select row, col, round((row_number() over (order by z, row, col) - 1) / (count(*) over () - 1)::double, 8) as pct from terrain")
def f01_percent_rank(spark, d):
    return R.percent_rank(_dem(spark, d)).select("row", "col", F.round("pct", 8).alias("pct"))


@query(V.sql("terrain") + " select row, col, round((2 * (rank() over (order by z) - 1) + count(*) over (partition by z) - 1) / (2.0 * (count(*) over () - 1)), 8) as pct from terrain")
def f02_midrank(spark, d):
    return R.midrank(_dem(spark, d)).select("row", "col", F.round("pct", 8).alias("pct"))


@query(V.sql("terrain") + """, o as (select i - 2 as i from range(5) a(i)), lines as (select row, max(col) as most from terrain group by 1), columns_ as (select col, max(row) as most from terrain group by 1),
  across as (select t.row, t.col, avg(n.z) as m from terrain t join lines l on l.row = t.row, o join terrain n on n.row = t.row and n.col = least(greatest(t.col + i, 0), most) group by 1, 2)
select t.row, t.col, round(avg(n.m), 6) as v from across t join columns_ c on c.col = t.col, o join across n on n.col = t.col and n.row = least(greatest(t.row + i, 0), most) group by 1, 2""")
def f06_box_mean(spark, d):
    return R.box_mean(_dem(spark, d)).select("row", "col", F.round("v", 6).alias("v"))


@query(V.sql("terrain") + " select (row // 8) * 8 + 0 as block_row, col // 8 as block_col, arg_max(row, (z, -row, -col)) as row, arg_max(col, (z, -row, -col)) as col, max(z) as v from terrain where z >= 1750 group by 1, 2")
def f11_block_peaks(spark, d):
    p = R.block_peaks(_dem(spark, d), 8, 1750.0)
    return p.select((F.floor(F.col("row") / 8) * 8).cast("long").alias("block_row"), F.floor(F.col("col") / 8).cast("long").alias("block_col"), "row", "col", "v")


@query(_D8 + " select row, col, k from d8")
def h02_d8(spark, d):
    return R.flow_directions(_dem(spark, d), 10.0).select("row", "col", "k")


_ACC = _D8.replace("with ", "with recursive ", 1) + f""", r as (select d.row * 64 + d.col as c, (d.row + o.dr) * 64 + d.col + o.dc as t from d8 d join {_OFF} on o.k = d.k),
  up as (select row * 64 + col as origin, row * 64 + col as c from d8 union all select up.origin, r.t from up join r on r.c = up.c),
  acc as (select c // 64 as row, c % 64 as col, count(*) as acc from up group by 1, 2)"""


@query(_ACC + " select row, col, acc from acc")
def h03_accumulation(spark, d):
    return R.accumulate(R.flow_directions(_dem(spark, d), 10.0), 64)


_SLOPE = """, steps as (select row, col, (coalesce(lead(z) over a, z) - coalesce(lag(z) over a, z)) / 20.0 as dx, (coalesce(lead(z) over b, z) - coalesce(lag(z) over b, z)) / 20.0 as dy
    from terrain window a as (partition by row order by col), b as (partition by col order by row)),
  slope as (select row, col, degrees(atan(sqrt(dx * dx + dy * dy))) as slope from steps)"""


@query(V.sql("terrain") + _SLOPE + " select row, col, round(slope, 6) as slope from slope")
def h04_slope(spark, d):
    return R.slope(_dem(spark, d), 10.0).select("row", "col", F.round("slope", 6).alias("slope"))


@query(_ACC + _SLOPE + " select row, col, round(ln(greatest(acc * 10.0, 10.0) / tan(radians(greatest(slope, 0.5)))), 6) as twi from acc join slope using (row, col)")
def h05_wetness_index(spark, d):
    acc = R.accumulate(R.flow_directions(_dem(spark, d), 10.0), 64)
    s = R.slope(_dem(spark, d), 10.0)
    return acc.join(s, ["row", "col"]).select("row", "col", F.round(R.wetness(F.col("acc"), F.col("slope"), 10.0), 6).alias("twi"))


_GROUP = V.sql("terrain", "classes").replace("with ", "with recursive ", 1) + f""", c as (select row, col, row * 64 + col as id from classes where v in (0, 4)),
  e as (select a.id as a, b.id as b from c a, {_OFF} join c b on b.row = a.row + o.dr and b.col = a.col + o.dc),
  w as (select id as origin, id as pos from c union select w.origin, e.b from w join e on e.a = w.pos)"""


@query(_GROUP + " select origin // 64 as row, origin % 64 as col, min(pos) as label from w group by origin")
def h09_components(spark, d):
    c = V.classes(spark, d).where("v in (0, 4)").select("row", "col")
    return R.label_components(c, 64)


@query(_D8 + ", c as (select row, col, z from terrain join d8 using (row, col) where k = -1) select row, col, z as v from c")
def h18_outlets(spark, d):
    return R.flow_directions(_dem(spark, d), 10.0).where("k = -1").select("row", "col", "v")


@query(V.sql("entities", "terrain") + """, q as (select entity_id, floor((320 - y) / 10) as r0, floor((x + 320) / 10) as c0 from entities),
  ring as (select q.entity_id, t.z from q join terrain t on (t.row - r0) * (t.row - r0) + (t.col - c0) * (t.col - c0) between 16 and 25)
select entity_id, round(avg(z), 6) as ring_mean, round(stddev_pop(z), 6) as ring_sd, count(*) as n from ring group by 1""")
def h20_prominence_ring(spark, d):
    """Mean and spread of heights on a ring of cells 4 to 5 cells away."""
    ring = [(r, c) for r in range(-5, 6) for c in range(-5, 6) if 16 <= r * r + c * c <= 25]
    p = V.entities(spark, d).select("entity_id", GRID.row(F.col("y")).alias("r0"), GRID.col(F.col("x")).alias("c0"))
    at = p.withColumn("o", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ring])))
    at = at.withColumn("row", F.col("r0") + F.col("o.r")).withColumn("col", F.col("c0") + F.col("o.c"))
    return at.join(_dem(spark, d), ["row", "col"]).groupBy("entity_id").agg(F.round(F.avg("v"), 6).alias("ring_mean"), F.round(F.stddev_pop("v"), 6).alias("ring_sd"), F.count("*").alias("n"))


_SIGHT = """sight as (select s_suppkey::bigint as pair_id, (s_suppkey * 41 % 600 - 300)::double as x, (315 - 15 * s_suppkey)::double as y,
    (s_suppkey * 53 % 600 - 300)::double as x2, (315 - 15 * s_suppkey - s_suppkey * 29 % 150)::double as y2 from supplier)"""


def _pairs(spark, d):
    """Eyes and targets along the strip, one pair per supplier."""
    k = F.col("s_suppkey").cast("long")
    y = 315 - 15 * k
    return V.table(spark, d, "supplier").select(
        k.alias("pair_id"), (k * 41 % 600 - 300).cast("double").alias("x"), y.cast("double").alias("y"), (k * 53 % 600 - 300).cast("double").alias("x2"), (y - k * 29 % 150).cast("double").alias("y2")
    )


@query(V.sql("terrain") + f""", {_SIGHT}, ends as (select g.*, a.z + 1.7 as z1, b.z + 10.0 as z2 from sight g join terrain a on a.row = floor((320 - y) / 10) and a.col = floor((x + 320) / 10) join terrain b on b.row = floor((320 - y2) / 10) and b.col = floor((x2 + 320) / 10)),
  steps as (select *, i / 200.0::double as f from ends, range(1, 200) r(i)),
  p as (select pair_id, f, z1 + (z2 - z1) * f - t.z - (1 - 1/7.0::double) * ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) / (2 * 6371000.0) * f * (1 - f) as clear
    from steps join terrain t on t.row = floor((320 - (y + (y2 - y) * f)) / 10) and t.col = floor((x + (x2 - x) * f + 320) / 10))
select pair_id, round(min(clear), 6) as clearance, min(clear) >= 0 as visible from p group by 1""")
def k04_line_of_sight(spark, d):
    """Least clearance between the ground and a straight line of sight, over 199 samples of every pair."""
    dem = _dem(spark, d)
    pairs = R.sample(_pairs(spark, d), dem, GRID, "inner").withColumnRenamed("v", "z").withColumn("z", F.col("z") + 1.7)
    far = R.sample(pairs.select("pair_id", F.col("x2").alias("x"), F.col("y2").alias("y")), dem, GRID, "inner").select("pair_id", (F.col("v") + 10.0).alias("z2"))
    found = sight.line_of_sight(pairs.join(far, "pair_id"), dem, GRID)
    return found.select("pair_id", F.round("clearance", 6).alias("clearance"), (F.col("clearance") >= 0).alias("visible"))
