"""Telemetry queries over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landloom import views as V
from landloom.operators import telemetry as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark, d):
    """Events as telemetry: a fix on every event but errors, a label on signups, a bad kind now and then."""
    e = V.table(spark, d, "events")
    kind = F.when(F.col("event_id") % 50 == 0, "junk").when(F.col("event_type") == "purchase", "data").when(F.col("event_type") == "error", "status").otherwise("position")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    fix = F.col("event_type") != "error"
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("device_id"), kind.alias("kind"), ms.alias("observed_ms"), ms.alias("received_ms"),
        F.when(fix, (F.col("event_id") * 13 % 1800) / F.lit(10.0) - 90).alias("lat"), F.when(fix, (F.col("event_id") * 29 % 3600) / F.lit(10.0) - 180).alias("lon"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("name"), F.col("event_id").cast("string"))).alias("label"), F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("gateway_id"),
    )


_EV = """ev as (select event_id as id, 'd' || user_id as device_id, case when event_id % 50 = 0 then 'junk' when event_type = 'purchase' then 'data' when event_type = 'error' then 'status' else 'position' end as kind,
  epoch_us(ts) // 1000 as observed_ms, case when event_type <> 'error' then (event_id * 13 % 1800) / 10.0::double - 90 end as lat, case when event_type <> 'error' then (event_id * 29 % 3600) / 10.0::double - 180 end as lon,
  case when event_type = 'signup' then 'name' || event_id end as label, 'g' || (user_id % 4) as gateway_id from events)"""


@query(f"with {_EV} select coalesce(case when kind = 'junk' then 'kind' end, 'sound') as problem, count(*) as n from ev group by 1")
def l01_validate(spark, d):
    return T.validate(events(spark, d)).groupBy(F.coalesce("problem", F.lit("sound")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"""with {_EV} select device_id, arg_max(kind, id) as kind, max(observed_ms) filter (where id = top) as observed_ms, arg_max(lat, id) filter (where lat is not null) as lat, arg_max(lon, id) filter (where lat is not null) as lon,
  arg_max(observed_ms, id) filter (where lat is not null) as position_ms, arg_max(label, id) filter (where label is not null) as label from (select *, max(id) over (partition by device_id) as top from ev where kind <> 'junk') group by 1""")
def l02_latest_state(spark, d):
    return T.latest_state(events(spark, d).where("kind <> 'junk'")).drop("gateway_id")


@query(f"""with {_EV}, s as (select device_id, arg_max(observed_ms, id) as t, arg_max(lat, id) filter (where lat is not null) as lat from ev group by 1), n as (select max(observed_ms) + 30000 as now from ev)
select device_id, case when lat is null then 'no_location' when (now - t) / 1000.0 <= 120 then 'active' when (now - t) / 1000.0 <= 900 then 'stale' else 'offline' end as state from s, n""")
def l04_freshness(spark, d):
    e = events(spark, d)
    now = e.agg((F.max("observed_ms") + 30000).alias("now"))
    return T.latest_state(e).join(F.broadcast(now)).select("device_id", T.freshness(F.col("observed_ms"), F.col("lat"), F.col("now")).alias("state"))


@query(f"with {_EV} select id, device_id, observed_ms from ev where kind = 'position' and device_id in ('d1', 'd2', 'd3') order by observed_ms desc, id desc limit 25")
def l07_history(spark, d):
    return T.history(events(spark, d), devices=["d1", "d2", "d3"], kind="position", limit=25).select("id", "device_id", "observed_ms")


@query(f"with {_EV} select device_id, arg_max(id, (observed_ms, id)) as id, arg_max(kind, (observed_ms, id)) as kind from ev where observed_ms <= epoch_ms(timestamp '2024-01-15 12:00:00') group by 1")
def l08_snapshot_as_of(spark, d):
    return T.snapshot_as_of(events(spark, d), 1705320000000).select("device_id", "id", "kind")


def _fixes(spark, d):
    e = V.table(spark, d, "events").where("event_type <> 'error'")
    return e.select(F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("device_id"), (F.col("event_id") * 60000).alias("t"), (F.col("event_id") * 17 % 900).cast("double").alias("x"), (F.col("event_id") * 31 % 900).cast("double").alias("y"))


_LEGS = """fixes as (select 'd' || (user_id % 3) as device_id, event_id * 60000 as t, (event_id * 17 % 900)::double as x, (event_id * 31 % 900)::double as y from events where event_type <> 'error'),
  legs0 as (select *, lead(t) over w as t2, lead(x) over w as x2, lead(y) over w as y2 from fixes window w as (partition by device_id order by t)),
  legs as (select *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) as distance, (t2-t)/1000.0 <= 120 and sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))/((t2-t)/1000.0) <= 12 as smooth from legs0 where t2 is not null)"""


@query(f"with {_LEGS} select device_id, t, smooth, round(distance, 6) as distance, round(case when distance >= 0.5 then (degrees(atan2(x2-x, y2-y)) + 360) % 360 end, 6) as heading from legs")
def l12_track_legs(spark, d):
    return T.legs(_fixes(spark, d)).select("device_id", "t", "smooth", F.round("distance", 6).alias("distance"), F.round("heading", 6).alias("heading"))


@query(f"with {_LEGS}, n as (select *, least(greatest(ceil(distance/5), 2), 24)::int as n from legs where smooth) select device_id, count(*) as points, round(sum(x + (x2-x)*i/n), 3) as sx from (select *, unnest(range(0, n + 1)) as i from n) group by 1")
def l13_densify(spark, d):
    return T.densify(T.legs(_fixes(spark, d))).groupBy("device_id").agg(F.count("*").alias("points"), F.round(F.sum("x"), 3).alias("sx"))


@query(f"""with {_LEGS}, times as (select i * 7000017 as at_ms from range(1, 6) r(i)) select device_id, at_ms, round(x + (x2-x)*u, 6) as x, round(y + (y2-y)*u, 6) as y
  from (select *, case when smooth then least(greatest((at_ms - t)::double/(t2-t), 0), 1) else 0 end as u from legs join times on at_ms >= t and at_ms < t2)""")
def l11_interpolate(spark, d):
    times = spark.range(1, 6).select((F.col("id") * 7000017).alias("at"))
    return T.interpolate(T.legs(_fixes(spark, d)), times).select("device_id", F.col("at").alias("at_ms"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""with l as (select user_id, event_id as t, 'l' || event_id as label from events where event_type = 'signup'), q as (select user_id, event_id as t from events where event_type = 'purchase')
select q.user_id, q.t as at_id, (select max_by(label, l.t) from l where l.user_id = q.user_id and l.t <= q.t) as label from q""")
def c26_as_of_label(spark, d):
    e = V.table(spark, d, "events")
    labels = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("t"), F.concat(F.lit("l"), F.col("event_id").cast("string")).alias("label"))
    asks = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at"))
    return T.as_of_label(asks, labels, "user_id").select("user_id", F.col("at").alias("at_id"), "label")


@query("""with m as (select user_id, event_id, value >= 50 as flag from events), s as (select *, coalesce(flag <> lag(flag) over (partition by user_id order by event_id), true)::int as st from m),
  r as (select *, sum(st) over (partition by user_id order by event_id) as run from s) select user_id, any_value(flag) as flag, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from r group by user_id, run""")
def f07_islands(spark, d):
    i = T.islands(V.table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") >= 50)
    return i.select("user_id", "flag", F.col("first").alias("first_id"), F.col("last").alias("last_id"), "n")


@query("select event_id, user_id from (select event_id, user_id, value, row_number() over (order by ts desc, event_id desc) as r from events) where r <= 40")
def f14_newest_then_ascending(spark, d):
    return V.table(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(40).orderBy("ts", "event_id").select("event_id", "user_id")


@query(f"with {_EV}, a as (select id, device_id, kind from ev), b as (select id, device_id, kind from ev where observed_ms < epoch_ms(timestamp '2024-01-16')) select id, device_id, kind from a where id not in (select id from b)")
def l09_export_once(spark, d):
    """Events exported now that were not exported before."""
    o = events(spark, d).select(F.col("id"), F.col("device_id"), F.col("kind"), F.col("device_id").alias("entity_id"), F.lit("event").alias("attr"), F.col("id").cast("string").alias("value"), "observed_ms", F.lit(None).cast("string").alias("source"))
    before = F.unix_millis(F.lit("2024-01-16").cast("timestamp"))
    return T.unexported(o, o.where(F.col("observed_ms") < before)).select("id", "device_id", "kind")


@query("""select user_id, count(*) as n, sum(k)::bigint as total from (select user_id, (props->>'k')::bigint as k from events) where k is not null group by 1""")
def l18_flatten_details(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return V.table(spark, d, "events").select("user_id", k.alias("k")).where("k is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("""select user_id, time_bucket(interval '1 hour', ts)::varchar as hour, count(*) as n from events group by 1, 2""")
def l19_hourly_windows(spark, d):
    w = V.table(spark, d, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


@query("""with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval '6 hours', true)::int as st from events),
  r as (select *, sum(st) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, s::bigint as session, count(*) as n from r group by 1, 2""")
def l20_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    e = V.table(spark, d, "events").select("user_id", "ts")
    start = F.coalesce((F.col("ts") - F.lag("ts").over(w)) > F.expr("interval 6 hours"), F.lit(True)).cast("int")
    s = e.withColumn("st", start).withColumn("s", F.sum("st").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", F.col("s").alias("session")).agg(F.count("*").alias("n"))
