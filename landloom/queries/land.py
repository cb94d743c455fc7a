"""Entity store, filters, spatial joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landloom import views as V
from landloom.functions import geo
from landloom.operators import filters, spatial, store

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _whole(spark, d):
    """Entities of kind customer with their lifecycle."""
    return V.entities(spark, d).join(V.lifecycle(spark, d), "entity_id")


_LATEST = "latest as (select entity_id, attr, arg_max(value, obs_id) as value, arg_max(num, obs_id) as num, max(obs_id) as obs_id from observations group by entity_id, attr)"


@query(V.sql("entities", "observations", "lifecycle") + f""", {_LATEST}, hit as (
  select e.entity_id, sqrt((x - 100)*(x - 100) + (y + 50)*(y + 50)) as d
  from entities e join lifecycle l using (entity_id)
  join latest a on a.entity_id = e.entity_id and a.attr = 'purchase' and a.num >= 1000
  join latest b on b.entity_id = e.entity_id and b.attr = 'view' and b.num < 9000
  where kind = 'customer' and retired_run_id is null and (x - 100)*(x - 100) + (y + 50)*(y + 50) <= 1500*1500)
select entity_id, round(d, 6) as distance, (select count(*) from hit)::bigint as total from hit order by d, entity_id limit 50""")
def b01_find_entities(spark, d):
    """Region, liveness, two attribute filters, distance order, limit and total."""
    return store.find(
        _whole(spark, d), V.observations(spark, d), "customer", filters.region({"within_m": 1500, "point": [100, -50]}), (100.0, -50.0),
        [filters.parse_filter("purchase >= 1000"), filters.parse_filter("view < 9000")], 50,
    ).select("entity_id", F.round("distance", 6).alias("distance"), "total")


@query(V.sql("entities") + " select entity_id from entities where x between -500 and 700 and y between -300 and 900")
def b05_bbox(spark, d):
    r = filters.region({"bbox": [-500, -300, 700, 900]})
    return V.entities(spark, d).where(r.holds(F.col("x"), F.col("y"))).select("entity_id")


@query(V.sql("entities", "edges") + """, tests as (
  select e.entity_id, sum(case when (y2 > y) <> (y1 > y) and x < (x2-x1)*(y-y1)/nullif(y2-y1, 0) + x1 then 1 else 0 end) as n
  from entities e, edges where parcel_id = 12 group by e.entity_id)
select entity_id from tests where n % 2 = 1""")
def b07_polygon(spark, d):
    k = 12
    x0, y0 = (k % 5) * 700 - 1750, k // 5 * 700 - 1750
    ring = [(x0 + a, y0 + b) for a, b in ((0, 0), (600, 0), (600, 300), (300, 300), (300, 600), (0, 600))]
    r = filters.region({"polygon": [ring]})
    return V.entities(spark, d).where(r.holds(F.col("x"), F.col("y"))).select("entity_id")


@query(V.sql("segments") + """, steps as (
  select stream_id, x1 + (x2 - x1) * i / 64.0 as x, y1 + (y2 - y1) * i / 64.0 as y from segments, range(65) r(i))
select distinct stream_id from steps where x between -400 and 400 and y between -400 and 400""")
def b10_line_in_region(spark, d):
    """Paths with a sampled point in a box; 64 samples a segment."""
    e = V.streams(spark, d).select("stream_id", F.explode(geo.edges(F.col("path"))).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    at = lambda c: F.col(f"e.a.{c}") + (F.col(f"e.b.{c}") - F.col(f"e.a.{c}")) * F.col("i") / 64.0
    r = filters.region({"bbox": [-400, -400, 400, 400]})
    return e.where(r.holds(at("x"), at("y"))).select("stream_id").distinct()


@query("""select doc_id, case when regexp_matches(lower(text), 'trail cam|trailcam|camera|wildlife') then 'trailcam'
  when regexp_matches(lower(text), 'well|spring|water source') then 'well' when regexp_matches(lower(text), 'garden|orchard|vegetable') then 'garden'
  when regexp_matches(lower(text), 'house|cabin|structure|building|barn') then 'structure' else 'overlook' end as objective from documents""")
def b15_text_objective(spark, d):
    return V.table(spark, d, "documents").select("doc_id", filters.objective_of(F.col("text")).alias("objective"))


_TERM = "regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])%s($|[^\\p{L}\\p{N}_])')"


@query("select doc_id, list_filter([" + ", ".join(f"case when {_TERM % t} then '{t}' end" for t in ("the", "und", "que")) + "], lambda t: t is not null)::varchar as terms from documents")
def b16_vocabulary_terms(spark, d):
    found = filters.terms_in(F.col("text"), ["the", "und", "que"])
    return V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("terms"))


@query(V.sql("observations") + " select kind, attr, n, obs from (select 'customer' as kind, attr, count(distinct entity_id) as n, count(*) as obs from observations group by attr)")
def c01_observations_of_kind(spark, d):
    e = V.entities(spark, d).select("entity_id", "kind")
    j = V.observations(spark, d).join(e, "entity_id")
    return j.groupBy("kind", "attr").agg(F.count_distinct("entity_id").alias("n"), F.count("*").alias("obs"))


@query(V.sql("observations") + f", {_LATEST} select entity_id, attr, value, obs_id from latest")
def c02_latest_state(spark, d):
    return store.latest(V.observations(spark, d)).select("entity_id", "attr", "value", "obs_id")


@query(V.sql("observations") + """, runs as (select distinct run_id from observations)
select r.run_id, o.entity_id, o.attr, arg_max(o.value, o.obs_id) as value from runs r join observations o on o.run_id <= r.run_id
where o.attr in ('purchase', 'error') group by all""")
def c03_as_of_run(spark, d):
    o = V.observations(spark, d).where("attr in ('purchase', 'error')")
    return store.as_of(o, V.observations(spark, d).select("run_id").distinct())


@query(V.sql("observations", "lifecycle") + """, runs as (select distinct run_id from observations)
select r.run_id, count(*) as n from runs r join lifecycle l on l.created_run_id <= r.run_id and (l.retired_run_id is null or l.retired_run_id > r.run_id) group by 1""")
def c04_alive_per_run(spark, d):
    return store.alive_per_run(V.lifecycle(spark, d), V.observations(spark, d).select("run_id").distinct())


@query(V.sql("observations", "lifecycle") + " select o.entity_id, count(*) as n from observations o where o.entity_id in (select entity_id from lifecycle where retired_run_id is not null) group by 1")
def c05_semi_join(spark, d):
    gone = V.lifecycle(spark, d).where("retired_run_id is not null")
    return V.observations(spark, d).join(gone, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("n"))


@query(V.sql("entities") + " select e.kind, n.n_name as nation, count(*) as n from entities e left join nation n on n.n_nationkey = e.nation group by 1, 2")
def c06_dimension_lookup(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation_key"), F.col("n_name").alias("nation_name"))
    j = V.entities(spark, d).join(n, F.col("nation") == F.col("nation_key"), "left")
    return j.groupBy("kind", F.col("nation_name").alias("nation")).agg(F.count("*").alias("n"))


@query(V.sql("entities", "edges") + """, tests as (
  select e.entity_id, g.parcel_id, sum(case when (y2 > y) <> (y1 > y) and x < (x2-x1)*(y-y1)/nullif(y2-y1, 0) + x1 then 1 else 0 end) as n
  from entities e, edges g group by 1, 2) select entity_id, parcel_id from tests where n % 2 = 1""")
def c08_points_in_polygons(spark, d):
    return spatial.points_in_polygons(V.entities(spark, d).select("entity_id", "x", "y"), V.parcels(spark, d)).select("entity_id", "parcel_id")


@query(V.sql("entities") + """ select a.entity_id as customer, b.entity_id as supplier, ((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))::bigint as d2
  from entities a, entities b where a.kind = 'customer' and b.kind = 'supplier' and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 300*300""")
def c09_within_distance(spark, d):
    e = V.entities(spark, d)
    left = e.where("kind = 'customer'").select(F.col("entity_id").alias("customer"), "x", "y")
    right = e.where("kind = 'supplier'").select(F.col("entity_id").alias("supplier"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial.within_distance(left, right, 300.0).select("customer", "supplier", F.col("d2").cast("long").alias("d2"))


@query(V.sql("entities", "segments") + """, t as (
  select e.entity_id, s.stream_id, x, y, x1, y1, x2, y2, case when (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) > 0
    then least(greatest(((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 0), 1) else 0 end as u
  from entities e, segments s where e.kind = 'customer'), q as (
  select entity_id, stream_id, min((x-(x1+u*(x2-x1)))*(x-(x1+u*(x2-x1))) + (y-(y1+u*(y2-y1)))*(y-(y1+u*(y2-y1)))) as d2 from t group by 1, 2)
select entity_id, stream_id, round(sqrt(d2), 4) as distance from q where d2 <= 150*150""")
def c10_point_to_path(spark, d):
    p = V.entities(spark, d).where("kind = 'customer'").select("entity_id", "x", "y")
    return spatial.paths_within(p, V.streams(spark, d), "entity_id", "stream_id", 150.0).select("entity_id", "stream_id", F.round("distance", 4).alias("distance"))


@query(V.sql("entities") + """, p as (select a.entity_id as customer, b.entity_id as supplier, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) as d2
  from entities a, entities b where a.kind = 'customer' and b.kind = 'supplier' and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 800*800)
select customer, arg_min(supplier, (d2, supplier)) as supplier, min(d2)::bigint as d2 from p group by 1""")
def c13_nearest(spark, d):
    e = V.entities(spark, d)
    left = e.where("kind = 'customer'").select(F.col("entity_id").alias("customer"), "x", "y")
    right = e.where("kind = 'supplier'").select(F.col("entity_id").alias("supplier"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial.nearest(left, right, "customer", "supplier", 800.0).select("customer", "supplier", F.col("d2").cast("long").alias("d2"))


@query("""with a as (select user_id, event_type as attr, floor(value*100)::bigint as v, event_id from events where event_id % 2 = 0),
  b as (select user_id, event_type as attr, floor(value*100)::bigint as v, event_id from events where event_id % 2 = 1),
  la as (select user_id, attr, arg_max(v, event_id) as v from a group by all), lb as (select user_id, attr, arg_max(v, event_id) as v from b group by all)
select 'customer:' || lb.user_id as entity_id, lb.attr, case when la.user_id is null then 'created' when la.v = lb.v then 'unchanged' else 'updated' end as change
from lb left join la on la.user_id = lb.user_id and la.attr = lb.attr""")
def c23_diff_staged(spark, d):
    e = V.table(spark, d, "events").select(
        F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("entity_id"), F.col("event_type").alias("attr"),
        F.floor(F.col("value") * 100).cast("string").alias("value"), F.col("event_id").alias("obs_id"),
    )
    return store.diff(e.where("obs_id % 2 = 1"), e.where("obs_id % 2 = 0"))


@query(V.sql("edges") + """ select parcel_id, round(abs(sum(x1*y2 - x2*y1))/2, 3) as area, min(x1)::bigint as min_x, max(y1)::bigint as max_y from edges group by 1""")
def d03_area_and_box(spark, d):
    box = geo.bbox(F.col("ring"))
    return V.parcels(spark, d).select("parcel_id", F.round(geo.shoelace(F.col("ring")), 3).alias("area"), box["min_x"].cast("long").alias("min_x"), box["max_y"].cast("long").alias("max_y"))


@query(V.sql("edges") + ", c as (select parcel_id, sum(x) / 7 as x, sum(y) / 7 as y from corners group by 1) select parcel_id, round(x, 6) as x, round(y, 6) as y from c")
def d04_vertex_mean(spark, d):
    m = geo.vertex_mean(F.col("ring"))
    return V.parcels(spark, d).select("parcel_id", F.round(m["x"], 6).alias("x"), F.round(m["y"], 6).alias("y"))


@query(V.sql("entities") + " select entity_id, round(x + 476000, 3) as e, round(y + 4428000, 3) as n from entities where kind = 'supplier'")
def d07_utm_round_trip(spark, d):
    """Scene to degrees and back through the transverse Mercator series; the way back has to meet the start."""
    p = V.entities(spark, d).where("kind = 'supplier'").select("entity_id", geo.from_utm(F.col("x") + 476000, F.col("y") + 4428000, 13).alias("g"))
    back = p.select("entity_id", geo.to_utm(F.col("g.lon"), F.col("g.lat"), 13).alias("u"))
    return back.select("entity_id", F.round("u.e", 3).alias("e"), F.round("u.n", 3).alias("n"))


_E1 = V.sql("observations") + f""", {_LATEST}, state as (
  select entity_id, max(case when attr = 'purchase' then num end) as purchase, max(case when attr = 'error' then num % 5 end) as error from latest group by 1)"""


@query(_E1 + """ select coalesce(error::varchar, 'None') as grp, count(*) as n, sum(purchase)::bigint as total, min(purchase) as least, max(purchase) as most,
  round(avg(purchase), 3) as mean from state group by 1""")
def e01_aggregate_entities(spark, d):
    """Latest numeric attribute grouped by another; a missing group is "None"."""
    state = store.wide(V.observations(spark, d), ["purchase", "error"])
    n = F.col("purchase").try_cast("long")
    grp = F.coalesce((F.col("error").try_cast("long") % 5).cast("string"), F.lit("None"))
    return _all_entities(spark, d).join(state, "entity_id", "left").groupBy(grp.alias("grp")).agg(
        F.count("*").alias("n"), F.sum(n).alias("total"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 3).alias("mean")
    )


def _all_entities(spark, d):
    return V.observations(spark, d).select("entity_id").distinct()


@query(V.sql("entities", "observations", "lifecycle") + """ select kind, count(*) as total, count(*) filter (where retired_run_id is null) as alive
  from entities left join lifecycle using (entity_id) group by 1""")
def e02_kind_counts(spark, d):
    e = V.entities(spark, d).join(V.lifecycle(spark, d), "entity_id", "left")
    return e.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("retired_run_id").isNull()).alias("alive"))


@query(V.sql("entities", "edges") + """, tests as (
  select e.entity_id, e.kind, g.parcel_id, sum(case when (y2 > y) <> (y1 > y) and x < (x2-x1)*(y-y1)/nullif(y2-y1, 0) + x1 then 1 else 0 end) as n
  from entities e, edges g group by 1, 2, 3), inside as (select * from tests where n % 2 = 1)
select parcel_id, coalesce(kind, 'all') as kind, count(*) as n from inside group by grouping sets ((parcel_id, kind), (parcel_id))""")
def e03_region_summary(spark, d):
    j = spatial.points_in_polygons(V.entities(spark, d), V.parcels(spark, d))
    return j.rollup("parcel_id", "kind").agg(F.count("*").alias("n"), F.grouping("parcel_id").alias("g")).where("g = 0").select("parcel_id", F.coalesce("kind", F.lit("all")).alias("kind"), "n")


@query("""select d.day, d.kind, d.n, d.devices from (select ts::date::varchar as day, event_type as kind, count(*) as n, count(distinct user_id) as devices from events group by all) d""")
def e10_telemetry_summary(spark, d):
    return V.table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("devices"))


@query("select distinct ts::date::varchar as day from events union select distinct o_orderdate::date::varchar from orders")
def e11_distinct_days(spark, d):
    a = V.table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"))
    return a.union(V.table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string"))).distinct()


@query("""with t as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before from events)
select before as "from", event_type as "to", count(*) as n from t where before is not null group by all""")
def e16_transition_matrix(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = V.table(spark, d, "events").select("event_type", F.lag("event_type").over(w).alias("before")).where("before is not null")
    return t.groupBy(F.col("before").alias("from"), F.col("event_type").alias("to")).agg(F.count("*").alias("n"))


@query("""select event_type as kind, min(value) as least, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, max(value) as most from events group by 1""")
def e18_range_stats(spark, d):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return V.table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.min("value").alias("least"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.max("value").alias("most"))


_E25 = V.sql("observations", "lifecycle") + """, runs as (select distinct run_id from observations),
  alive as (select r.run_id, count(*) as trees, sum((split_part(l.entity_id, ':', 2)::bigint % 7 + 1) * (split_part(l.entity_id, ':', 2)::bigint % 7 + 1)) as r2
    from runs r join lifecycle l on l.created_run_id <= r.run_id and (l.retired_run_id is null or l.retired_run_id > r.run_id) group by 1)
select run_id, trees, round(3.14159265 * r2)::bigint as canopy_m2, trees - lag(trees) over (order by run_id) as tree_delta from alive"""


@query(_E25)
def e25_canopy_change(spark, d):
    r = F.substring_index("entity_id", ":", -1).cast("long") % 7 + 1
    n = store.alive_per_run(V.lifecycle(spark, d), V.observations(spark, d).select("run_id").distinct(), r * r)
    return n.select("run_id", F.col("n").alias("trees"), F.round(3.14159265 * F.col("s0")).cast("long").alias("canopy_m2"), (F.col("n") - F.lag("n").over(Window.orderBy("run_id"))).alias("tree_delta"))


@query(V.sql("observations") + " select obs_id, attr, value from observations where entity_id = 'customer:7'")
def f15_entity_history(spark, d):
    return store.history(V.observations(spark, d), "customer:7").select("obs_id", "attr", "value")


_CHAIN = """with recursive n as (select o_orderkey::varchar as id, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey)::varchar as parent, o_custkey from orders),
  start as (select id from n where o_custkey = (select min(o_custkey) from orders) and id not in (select parent from n where parent is not null)),
  up as (select 0 as depth, n.id, n.parent from n join start on n.id = start.id union all select depth + 1, n.id, n.parent from up join n on n.id = up.parent)
select depth::bigint as depth, id from up"""


@query(_CHAIN)
def f17_ancestry(spark, d):
    o = V.table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    n = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lag("o_orderkey").over(w).cast("string").alias("parent"), "o_custkey")
    first = o.agg(F.min("o_custkey")).first()[0]
    head = o.where(F.col("o_custkey") == first).orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).first()["o_orderkey"]
    return store.ancestry(n, str(head)).select(F.col("depth").cast("long").alias("depth"), "id")


@query("""with p as (select distinct user_id from events), s as (select distinct o_custkey as user_id from orders)
select 'customer:' || coalesce(p.user_id, s.user_id) as entity_id, case when p.user_id is null then 'created' when s.user_id is null then 'retired' else 'kept' end as change
from p full join s on p.user_id = s.user_id""")
def f18_reconcile(spark, d):
    """Customers seen in events against those with orders."""
    named = lambda name, key: V.table(spark, d, name).select(F.concat(F.lit("customer:"), F.col(key).cast("string")).alias("entity_id"))
    return store.reconcile(named("events", "user_id").distinct(), named("orders", "o_custkey"))


@query("""select p_brand as attr, p_type as kind, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_type) as rank
  from part group by 1, 2 qualify rank <= 3""")
def f16_top_values(spark, d):
    n = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("attr"), F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("attr").orderBy(F.col("n").desc(), "kind")).cast("long")).where("rank <= 3")


@query(V.sql("observations") + """, t as (select *, lag(value) over (partition by entity_id, attr order by obs_id) as before, row_number() over (partition by entity_id, attr order by obs_id) as k from observations)
select obs_id, entity_id, attr, value from t where k = 1 or value is distinct from before""")
def n01_observe_changed(spark, d):
    return store.changed_only(V.observations(spark, d)).select("obs_id", "entity_id", "attr", "value")
