"""Constructed geometry over the test tables: overlays, buffers, outlines, hulls, distance fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import views as V
from landloom.functions import geo
from landloom.operators import layers, shapes, spatial

from .ground import GRID

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(V.sql("terrain", "classes") + """, s as (select row as r, col as c from classes where v = 4)
select row, col, round(min(sqrt((row - r) * (row - r) + (col - c) * (col - c))) * 10, 6) as distance from terrain, s group by 1, 2""")
def d09_distance_field(spark, d):
    """Distance of every cell to the nearest cell of a class."""
    return shapes.distance_field(V.classes(spark, d), F.col("v") == 4, 10.0).select("row", "col", F.round("distance", 6).alias("distance"))


@query()
def d13_buffers(spark, d):
    """Area and number of rings of the outline 40 m around every stream; held against a fine grid in the tests."""
    rings = shapes.ring_areas(shapes.buffer(V.streams(spark, d), "stream_id", 40.0))
    return rings.groupBy(F.col("group").alias("stream_id")).agg(F.count("*").alias("rings"), F.round(F.sum("area"), 3).alias("area"))


_HULL = """p as (select distinct nation as g, x, y from entities where kind = 'customer'),
  e as (select a.g, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from p a join p b on a.g = b.g and (a.x <> b.x or a.y <> b.y)
    where not exists (select 1 from p c where c.g = a.g and ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
      or ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 and ((c.x - a.x) * (c.x - b.x) > 0 or (c.y - a.y) * (c.y - b.y) > 0))))),
  r as (select e.g, x1, y1, max((x - x1) * ux + (y - y1) * uy) - min((x - x1) * ux + (y - y1) * uy) as w, max((y - y1) * ux - (x - x1) * uy) as h
    from (select *, (x2 - x1) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as ux, (y2 - y1) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as uy from e) e join p on p.g = e.g group by 1, 2, 3)"""


@query(V.sql("entities") + f""", {_HULL}, a as (select g, count(*)::int as corners, round(sum(x1 * y2 - x2 * y1) / 2, 4) as area from e group by 1),
  least_ as (select g, arg_min(greatest(w, h), w * h) as long, arg_min(least(w, h), w * h) as short from r group by 1)
select a.g as nation, corners, area, round(long, 4) as long, round(short, 4) as short from a join least_ l on l.g = a.g""")
def d16_footprints(spark, d):
    """Hull and least rectangle of the customers of each nation."""
    found = shapes.footprints(V.entities(spark, d).where("kind = 'customer'"), "nation")
    return found.select(F.col("group").alias("nation"), "corners", *[F.round(c, 4).alias(c) for c in ("area", "long", "short")])


_BANDS = """b as (select row, col, floor(z / 40)::bigint as v from terrain),
  sides as (select b.row, b.col, b.v, o.k, n.v is distinct from b.v as edge from b, (values (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) o(k, dr, dc) left join b n on n.row = b.row + o.dr and n.col = b.col + o.dc),
  turned as (select a.v, count(*) filter (where a.edge and c.edge) as convex, 0 as concave from sides a join sides c on c.row = a.row and c.col = a.col and c.k = (a.k + 1) % 4 group by 1),
  inner_ as (select b.v, count(*) as concave from b, (values (-1, 1), (1, 1), (1, -1), (-1, -1)) o(dr, dc) join b n on n.row = b.row + o.dr and n.col = b.col and n.v = b.v
    join b m on m.row = b.row and m.col = b.col + o.dc and m.v = b.v left join b x on x.row = b.row + o.dr and x.col = b.col + o.dc where x.v is distinct from b.v group by 1)"""


@query(V.sql("terrain") + f""", {_BANDS}, size as (select v, count(*) * 100.0::double as area from b group by 1), sides_ as (select v, count(*) filter (where edge) as sides from sides group by 1)
select s.v, s.area, sides, convex + coalesce(i.concave, 0) as turns from size s join sides_ using (v) join turned t on t.v = s.v left join inner_ i on i.v = s.v""")
def d17_polygonise(spark, d):
    """Outlines of the height bands: area by the rings (holes negative), sides of cells passed and turns taken."""
    bands = V.terrain(spark, d).select("row", "col", F.floor(F.col("z") / 40).alias("v"))
    corners = shapes.polygonise(bands, GRID)
    n = corners.groupBy("ring").agg(F.count("*").alias("n"))
    side = corners.join(n, "ring").select("group", "ring", "seq", "n", (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"))
    before = side.select("ring", ((F.col("seq") + 1) % F.col("n")).alias("seq"), F.col("dx").alias("px"), F.col("dy").alias("py"))
    turned = F.col("dx") * F.col("py") != F.col("dy") * F.col("px")
    turns = side.join(before, ["ring", "seq"]).groupBy("group").agg(F.count("*").alias("sides"), F.count_if(turned).alias("turns"))
    areas = shapes.ring_areas(corners).groupBy("group").agg(F.round(F.sum("area"), 3).alias("area"))
    return areas.join(turns, "group").select(F.col("group").alias("v"), "area", "sides", "turns")


@query(V.sql("entities") + """, sq as (select key as k, x - 200 as a, y - 200 as b, x + 200 as c, y + 200 as e from entities where kind = 'supplier'),
  boxes as (select n_nationkey::bigint as parcel_id, (n_nationkey % 5) * 700 - 1750 + w.a as a, (n_nationkey // 5) * 700 - 1750 + w.b as b, (n_nationkey % 5) * 700 - 1750 + w.c as c, (n_nationkey // 5) * 700 - 1750 + w.e as e
    from nation, (values (0, 0, 600, 300), (0, 300, 300, 600)) w(a, b, c, e)),
  met as (select k, parcel_id, greatest(least(sq.c, boxes.c) - greatest(sq.a, boxes.a), 0) * greatest(least(sq.e, boxes.e) - greatest(sq.b, boxes.b), 0) as area from sq, boxes)
select k, parcel_id, round(sum(area), 3) as area from met group by 1, 2 having sum(area) > 0""")
def d17_clip(spark, d):
    """Parcels clipped to a square around every supplier."""
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    square = F.array(corner(-200, -200), corner(200, -200), corner(200, 200), corner(-200, 200), corner(-200, -200))
    near = V.entities(spark, d).where("kind = 'supplier'").select(F.col("key").alias("k"), square.alias("square"))
    pairs = layers.box_pairs(near.withColumn("box", geo.bbox(F.col("square"))), V.parcels(spark, d).withColumn("rbox", geo.bbox(F.col("ring"))), 500.0)
    group = F.struct("k", "parcel_id").alias("group")
    parts = pairs.select(group, F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("square").alias("ring")), F.struct(F.lit(1).alias("part"), F.col("ring")))).alias("p")).select("group", "p.part", "p.ring")
    return shapes.ring_areas(shapes.overlay(parts, "intersection")).groupBy("group").agg(F.round(F.sum("area"), 3).alias("area")).select("group.k", "group.parcel_id", "area")


@query("""with q as (select c_nationkey::bigint as nation, c_custkey * 53 % 100 as x, c_custkey * 29 % 100 + 100 * (c_custkey // 1500) as y from customer),
  c as (select distinct nation, x + i as x, y + j as y from q, range(12) a(i), range(12) b(j)) select nation, (count(*) * 100)::double as area from c group by 1""")
def d17_union(spark, d):
    """The ground under overlapping squares of 120 m, by nation."""
    k = F.col("c_custkey").cast("long")
    x, y = (k * 53 % 100 * 10).cast("double"), ((k * 29 % 100 + 100 * F.floor(k / 1500)) * 10).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    square = F.array(corner(0, 0), corner(120, 0), corner(120, 120), corner(0, 120), corner(0, 0))
    parts = V.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("group"), k.alias("part"), square.alias("ring"))
    return shapes.ring_areas(shapes.overlay(parts, "union")).groupBy(F.col("group").alias("nation")).agg(F.round(F.sum("area"), 3).alias("area"))


@query(V.sql("terrain", "edges") + """, wet as (select row, col, -320 + (col + 0.5) * 10.0::double as x, 320 - (row + 0.5) * 10.0::double as y from terrain where z < 1800),
  lakes as (select row, col from (select row, col, parcel_id, sum(case when (y2 > y) <> (y1 > y) and x < (x2-x1)*(y-y1)/nullif(y2-y1, 0) + x1 then 1 else 0 end) as n from wet, edges group by 1, 2, 3) where n % 2 = 1)
select count(*) * 100.0::double as area from wet where (row, col) not in (select (row, col) from lakes)""")
def a30_water_surface(spark, d):
    """Outlines of low ground outside the known lakes: what a raster adds to water that is mapped."""
    wet = V.terrain(spark, d).where("z < 1800").select("row", "col", GRID.x(F.col("col")).alias("x"), GRID.y(F.col("row")).alias("y"))
    lakes = spatial.points_in_polygons(wet, V.parcels(spark, d)).select("row", "col")
    rest = wet.join(lakes, ["row", "col"], "left_anti").select("row", "col", F.lit(1).alias("v"))
    return shapes.ring_areas(shapes.polygonise(rest, GRID)).agg(F.coalesce(F.round(F.sum("area"), 3), F.lit(0.0)).alias("area"))
