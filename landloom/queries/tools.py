"""Packets, time indexes, building clearance and table functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import views as V
from landloom.operators import packets as P
from landloom.operators import stems, survey, tools
from landloom.operators import telemetry as T

from .ground import GRID
from .layers import stems as stem_rows

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PACKETS = """k as (select event_id as id, user_id as u, value, (props->>'k')::bigint as n, event_id % 7 as shape from events)"""


def _packets(spark, d):
    """A packet per event, in the dialects of several senders."""
    e = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("long").alias("n"))
    shape = F.col("id") % 7
    says = lambda text: F.format_string(text, "u", "n", "n", "n")
    packet = (
        F.when(shape == 0, says('{"fromId": "!%08x", "rxTime": 17000000%02d, "rxSnr": "%d.5", "decoded": {"portnum": "POSITION_APP", "position": {"latitude": 40.5, "longitude": -105.25, "ground_track": %d}}}'))
        .when(shape == 1, says('{"from": %d, "rxTime": 0, "hopStart": 7, "hop_limit": %d, "decoded": {"position": {"latitudeI": 4050%03d00, "longitude_i": "-1052500000", "groundTrack": 18000000, "groundSpeed": "%d"}}}'))
        .when(shape == 2, says('{"from": "%d", "decoded": {"user": {"longName": "node %d"}, "text": "%d %d"}}'))
        .when(shape == 3, says('{"fromId": "base-%d", "rxRssi": -%d, "decoded": {"portnum": "TEXT_MESSAGE_APP", "text": " hello %d ", "x": %d}}'))
        .when(shape == 4, says('{"from": %d, "decoded": {"telemetry": {"deviceMetrics": {"batteryLevel": %d}, "time": "x%d"}, "n": %d}}'))
        .when(shape == 5, says('{"from": %d, "decoded": {"portnum": "ROUTING_APP", "n": [%d, %d, %d]}}'))
        .otherwise(says("not json %d %d %d %d"))
    )
    return e.select("id", packet.alias("packet"))


@query(f"""with {_PACKETS} select id, case when shape = 3 then 'base-' || u else '!' || lpad(lower(to_hex(u)), 8, '0') end as device_id, case shape when 0 then 'position' when 1 then 'position' when 3 then 'message' else 'status' end as kind,
  case when shape = 0 then (1700000000 + n) * 1000 end as observed_ms, round(case shape when 0 then 40.5 when 1 then 40.5 + n * 100 / 1e7 end::double, 7) as lat, case when shape in (0, 1) then -105.25::double end as lon,
  case shape when 0 then n::double when 1 then 180.0::double end as heading, case when shape = 1 then n::double end as speed, case when shape = 2 then 'node ' || n end as label, case when shape = 3 then 'hello ' || n end as message,
  case when shape = 4 then n::double end as battery, case when shape = 0 then n + 0.5::double end as snr, case when shape = 1 then greatest(7 - n, 0)::double end as hops from k where shape < 5""")
def a43_packets(spark, d):
    e = P.events(_packets(spark, d))
    return e.select("id", "device_id", "kind", "observed_ms", F.round("lat", 7).alias("lat"), "lon", "heading", "speed", "label", "message", "battery", "snr", "hops")


@query("""with p as (select o_orderkey, o_custkey as user_id, timestamp '2024-01-01' + interval 1 minute * (o_orderkey * 37 % 50000) as ts from orders), e as (select user_id, ts, max(event_id) as v from events group by 1, 2)
select o_orderkey, v from p asof left join e on p.user_id = e.user_id and p.ts >= e.ts""")
def l15_time_index(spark, d):
    """The last event of a user up to a time, for every order's customer."""
    k = F.col("o_orderkey")
    at = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(k * 37 % 50000).cast("int"))).alias("ts")
    probes = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), at)
    events = V.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return T.last_at(events, probes, "user_id", "ts", "event_id", "o_orderkey").select("o_orderkey", F.col("value").alias("v"))


@query()
def m08_building_clearance(spark, d):
    """Stems cleared of square buildings around suppliers; held against a loop over all of them in the tests."""
    k = F.col("s_suppkey").cast("long")
    x, y = (k * 41 % 600 - 300).cast("double"), (k * 67 % 600 - 300).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    square = F.array(corner(-6, -6), corner(6, -6), corner(6, 6), corner(-6, 6), corner(-6, -6))
    houses = V.table(spark, d, "supplier").select(k.alias("building_id"), square.alias("ring"), F.lit(1.0).alias("margin"))
    trees = stem_rows(spark, d).select(F.col("k").alias("id"), "x", "y", (F.col("radius") / 5).alias("radius"))
    return stems.clear_of_buildings(trees, houses)


@query(V.sql("entities", "terrain") + """, q as (select entity_id, sqrt((x - 100) * (x - 100) + (y + 50) * (y + 50)) as distance from entities where kind = 'supplier'), n as (select kind, count(*) as n from entities where x * x + y * y <= 490000 group by 1),
  s as (select i / 200.0::double as f, -300 + 600 * i / 200.0::double as x, 310 - 100 * i / 200.0::double as y from range(0, 201) r(i)), t as (select f, z as v from s join terrain on row = floor((320 - y) / 10) and col = floor((x + 320) / 10)),
  ends as (select max(case when f = 0 then v end) + 1.7 as a, max(case when f = 1 then v end) as b from t)
select 'found' as tool, entity_id as name, round(distance, 6) as value from q where distance <= 900 union all select 'summary', kind, n from n union all select 'sight', case when min(a + (b - a) * f - v) >= 0 then 'visible' else 'hidden' end, round(min(a + (b - a) * f - v), 6) from t, ends where f > 0 and f < 1""")
def n19_table_functions(spark, d):
    """Three land queries in SQL."""
    tools.register(spark, V.entities(spark, d), V.terrain(spark, d).withColumnRenamed("z", "v"), GRID)
    return spark.sql("""select 'found' as tool, entity_id as name, round(distance, 6) as value from find_entities('supplier', 100, -50, 900)
        union all select 'summary', kind, cast(n as double) from region_summary(0, 0, 700)
        union all select 'sight', if(visible, 'visible', 'hidden'), round(clearance, 6) from can_see(-300, 310, 300, 210)""")


_SURVEY = """staged as (select user_id as id, max((case when value < 20 then user_id * 10 else user_id * 10 + 1 end, user_id * 3, case when event_type = 'error' then 'gone' else 'alive' end, case when event_type <> 'view' then event_type end)) as r from events group by 1),
  s as (select id, r[1] as x, r[3] as status, r[4] as name from staged), l as (select c_custkey as id, c_custkey * 10 as x, case when c_nationkey = 3 then 'dead' else 'alive' end as status, 'signup' as name from customer)"""


@query(f"""with {_SURVEY} select coalesce(s.id, l.id) as id, case when s.id is null then 'absent' when s.status = 'gone' and (l.id is null or l.status = 'dead') then 'unchanged' when s.status = 'gone' then 'retired' when l.id is null or l.status = 'dead' then 'created'
  when s.x <> l.x then 'moved' when s.name is not null and s.name <> l.name then 'updated' else 'unchanged' end as change from s full join l on s.id = l.id""")
def a13_survey_changes(spark, d):
    """Users as a survey saw them in events against the customers that the store has."""
    u = F.col("user_id")
    staged = V.table(spark, d, "events").select(
        u.alias("id"), F.when(F.col("value") < 20, u * 10).otherwise(u * 10 + 1).cast("double").alias("x"), (u * 3).cast("double").alias("y"), F.when(F.col("event_type") == "error", "gone").otherwise("alive").alias("status"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("name"),
    )
    k = F.col("c_custkey").cast("long")
    latest = V.table(spark, d, "customer").select(k.alias("id"), (k * 10).cast("double").alias("x"), (k * 3).cast("double").alias("y"), F.when(F.col("c_nationkey") == 3, "dead").otherwise("alive").alias("status"), F.lit("signup").alias("name"))
    return survey.classify(staged, latest, ["name"]).select("id", "change")
