"""Land tables over the star-schema test data.

The same definitions exist twice: as DataFrames and as DuckDB text for the checks. All keys and
coordinates are integer arithmetic, so both engines agree to the last bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"), ("part", "p_partkey", None))
FIRST_DAY = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene_x(key: Column) -> Column:
    return ((key * 7919) % 4001 - 2000).cast("double")


def scene_y(key: Column) -> Column:
    """Every 4,001 keys fill a square of the scene; further ones follow to the north, so that density does not grow with the tables."""
    return ((key * 104729) % 4001 - 2000 + 4001 * F.floor(key / 4001)).cast("double")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_id, kind, key, nation, x, y``; parts belong to no nation."""
    parts = []
    for kind, key, nation in KINDS:
        k = F.col(key).cast("long")
        parts.append(
            table(spark, sf_dir, kind).select(
                F.concat(F.lit(f"{kind}:"), k.cast("string")).alias("entity_id"), F.lit(kind).alias("kind"), k.alias("key"),
                (F.col(nation) if nation else F.lit(None)).cast("long").alias("nation"), scene_x(k).alias("x"), scene_y(k).alias("y"),
            )
        )
    return reduce(DataFrame.union, parts)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs_id, entity_id, attr, value, num, run_id, observed_at, source``: one row per event.

    ``obs_id`` is a permutation of the event ids inside each 1,000,003, so its order is not that of time.
    """
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        (i * 7919 % 1000003 + 1000003 * F.floor(i / 1000003)).alias("obs_id"),
        F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("entity_id"),
        F.col("event_type").alias("attr"),
        F.floor(F.col("value") * 100).cast("long").cast("string").alias("value"),
        F.floor(F.col("value") * 100).cast("long").alias("num"),
        F.datediff(F.to_date("ts"), F.lit(FIRST_DAY)).cast("long").alias("run_id"),
        F.col("ts").alias("observed_at"),
        F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("source"),
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_id, created_run_id, retired_run_id``: every fifth observed entity is retired after its last run."""
    o = observations(spark, sf_dir).groupBy("entity_id").agg(F.min("run_id").alias("created_run_id"), F.max("run_id").alias("last"))
    key = F.substring_index("entity_id", ":", -1).cast("long")
    return o.select("entity_id", "created_run_id", F.when(key % 5 == 0, F.col("last") + 1).alias("retired_run_id"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row, col, z``: one cell per event on a strip 64 cells wide with integer heights; row 0 is the north edge.

    Valleys run west every 128 rows, roughened by the events' values. The last row may be short.
    """
    i = F.col("event_id")
    row, col = F.floor(i / 64).cast("long"), i % 64
    z = 1700 + 5 * col + 3 * F.abs(row % 128 - 64) + F.floor(F.col("value") * 100).cast("long") % 7
    return table(spark, sf_dir, "events").select(row.alias("row"), col.alias("col"), z.cast("double").alias("z"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row, col, v``: a raster of nine classes on the cells of ``terrain``."""
    return terrain(spark, sf_dir).select("row", "col", ((F.col("row") * 13 + F.col("col") * 7) % 9).alias("v"))


def terrain_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid of ``terrain``: one number."""
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // 64 + 1


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parcel_id, ring``: an L-shaped closed ring per nation."""
    k = F.col("n_nationkey").cast("long")
    x0, y0 = (k % 5) * 700 - 1750, F.floor(k / 5).cast("long") * 700 - 1750
    corner = lambda dx, dy: F.struct((x0 + dx).cast("double").alias("x"), (y0 + dy).cast("double").alias("y"))
    shape = [(0, 0), (600, 0), (600, 300), (300, 300), (300, 600), (0, 600), (0, 0)]
    return table(spark, sf_dir, "nation").select(k.alias("parcel_id"), F.array(*[corner(*d) for d in shape]).alias("ring"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream_id, path``: a polyline of three vertices per supplier."""
    k = F.col("s_suppkey").cast("long")
    at = lambda n: F.struct(scene_x(k + 17 * n).alias("x"), scene_y(k + 29 * n).alias("y"))
    return table(spark, sf_dir, "supplier").select(k.alias("stream_id"), F.array(at(0), at(1), at(2)).alias("path"))


_X, _Y = "((({k}) * 7919) % 4001 - 2000)::double", "((({k}) * 104729) % 4001 - 2000 + 4001 * (({k}) // 4001))::double"


def _entity(kind: str, key: str, nation: str | None) -> str:
    return (
        f"select '{kind}:' || {key} as entity_id, '{kind}' as kind, {key}::bigint as key, {nation or 'null'}::bigint as nation, "
        f"{_X.format(k=key)} as x, {_Y.format(k=key)} as y from {kind}"
    )


#: DuckDB text of the views, to stand after ``with``.
SQL = {
    "entities": "entities as (" + " union all ".join(_entity(*k) for k in KINDS) + ")",
    "observations": """observations as (
      select event_id * 7919 % 1000003 + 1000003 * (event_id // 1000003) as obs_id, 'customer:' || user_id as entity_id, event_type as attr,
             floor(value * 100)::bigint::varchar as value, floor(value * 100)::bigint as num,
             datediff('day', date '2024-01-01', ts::date)::bigint as run_id, ts as observed_at, 's' || (event_id % 3) as source
      from events)""",
    "lifecycle": """lifecycle as (
      select entity_id, min(run_id) as created_run_id,
             case when split_part(entity_id, ':', 2)::bigint % 5 = 0 then max(run_id) + 1 end as retired_run_id
      from observations group by entity_id)""",
    "terrain": """terrain as (
      select event_id // 64 as row, event_id % 64 as col,
             (1700 + 5 * (event_id % 64) + 3 * abs(event_id // 64 % 128 - 64) + floor(value * 100)::bigint % 7)::double as z
      from events)""",
    "classes": "classes as (select row, col, (row * 13 + col * 7) % 9 as v from terrain)",
    "edges": """corners as (
      select n_nationkey::bigint as parcel_id, c.i, ((n_nationkey % 5) * 700 - 1750 + c.dx)::double as x,
             ((n_nationkey // 5) * 700 - 1750 + c.dy)::double as y
      from nation, (values (0, 0, 0), (1, 600, 0), (2, 600, 300), (3, 300, 300), (4, 300, 600), (5, 0, 600), (6, 0, 0)) c(i, dx, dy)
    ), edges as (
      select a.parcel_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from corners a join corners b on a.parcel_id = b.parcel_id and b.i = a.i + 1)""",
    "segments": f"""vertices as (
      select s_suppkey::bigint as stream_id, n.n, {_X.format(k='s_suppkey + 17 * n.n')} as x, {_Y.format(k='s_suppkey + 29 * n.n')} as y
      from supplier, range(3) n(n)
    ), segments as (
      select a.stream_id, a.n, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from vertices a join vertices b on a.stream_id = b.stream_id and b.n = a.n + 1)""",
}


def sql(*views: str) -> str:
    return "with " + ", ".join(SQL[v] for v in views)
