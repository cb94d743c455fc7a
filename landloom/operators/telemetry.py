"""Device telemetry in batch: validation, folds to the latest state, history, tracks.

Events are ``id, device_id, kind, observed_ms, received_ms, lat, lon, label, gateway_id``; ``id`` is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("position", "message", "data", "status", "media", "command")
ACTIVE_S, OFFLINE_S = 120, 900


def parse_time(text: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 time with a zone, cut to whole seconds; null without a zone."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.unix_seconds(F.try_to_timestamp(text)) * 1000)


def validate(events: DataFrame) -> DataFrame:
    """All rows with ``problem``: null for a sound event, else why it goes to the dead letters."""
    e = F.col
    lat, lon = e("lat"), e("lon")
    problem = (
        F.when(~F.coalesce(e("kind").isin(*KINDS), F.lit(False)), "kind")
        .when(e("device_id").isNull() | (F.trim("device_id") == ""), "device")
        .when(e("observed_ms").isNull(), "time")
        .when(lat.isNull() != lon.isNull(), "position")
        .when((lat < -90) | (lat > 90) | (lon < -180) | (lon > 180) | F.isnan(lat) | F.isnan(lon), "position")
    )
    return events.withColumn("problem", problem)


def latest_state(events: DataFrame) -> DataFrame:
    """One row per device: its last event by arrival, and the last known position carried over events without one."""
    at = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("id")))
    fix = F.col("lat").isNotNull()
    named = F.col("label").isNotNull()
    return events.groupBy("device_id").agg(
        F.max_by("kind", "id").alias("kind"), F.max_by("observed_ms", "id").alias("observed_ms"), F.max_by("gateway_id", "id").alias("gateway_id"),
        at("lat", fix).alias("lat"), at("lon", fix).alias("lon"), at("observed_ms", fix).alias("position_ms"), at("label", named).alias("label"),
    )


def freshness(observed_ms: Column, lat: Column, now_ms: Column, bridge_down: Column | None = None) -> Column:
    """no_location, active, stale or offline. A bridge that is down makes all it serves offline."""
    age = (now_ms - observed_ms) / 1000
    state = F.when(lat.isNull(), "no_location").when(age <= ACTIVE_S, "active").when(age <= OFFLINE_S, "stale").otherwise("offline")
    return state if bridge_down is None else F.when(F.coalesce(bridge_down, F.lit(False)), "offline").otherwise(state)


def history(events: DataFrame, since_ms: int | None = None, until_ms: int | None = None, devices: list[str] | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
    """The newest ``limit`` events that match, oldest first."""
    if since_ms is not None:
        events = events.where(F.col("observed_ms") >= since_ms)
    if until_ms is not None:
        events = events.where(F.col("observed_ms") <= until_ms)
    if devices:
        events = events.where(F.col("device_id").isin(*devices))
    if kind:
        events = events.where(F.col("kind") == kind)
    newest = events.orderBy(F.col("observed_ms").desc(), F.col("id").desc()).limit(max(1, min(2000, limit)))
    return newest.orderBy("observed_ms", "id")


def snapshot_as_of(events: DataFrame, at_ms: int) -> DataFrame:
    """The last event of each device up to a time, by time, then arrival."""
    e = events.where(F.col("observed_ms") <= at_ms)
    return e.groupBy("device_id").agg(F.max_by(F.struct(*e.columns), F.struct("observed_ms", "id")).alias("e")).select("e.*")


def legs(fixes: DataFrame, max_gap_s: float = 120, max_speed: float = 12) -> DataFrame:
    """Consecutive fixes of a device (``device_id, t, x, y``) as legs, with ``smooth`` where they may be interpolated."""
    w = Window.partitionBy("device_id").orderBy("t")
    nxt = fixes.select("*", F.lead("t").over(w).alias("t2"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("t2 is not null")
    dt, dist = (F.col("t2") - F.col("t")) / 1000.0, F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    gate = (dt <= max_gap_s) & F.when(dt > 0, dist / dt <= max_speed).otherwise(False)
    return nxt.withColumn("distance", dist).withColumn("smooth", gate).withColumn("heading", F.when(dist >= 0.5, F.pmod(F.degrees(F.atan2(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))), F.lit(360.0))))


def densify(legs_: DataFrame, step_m: float = 5.0) -> DataFrame:
    """Points along smooth legs: 2 to 24 steps each, about ``step_m`` apart."""
    n = F.least(F.greatest(F.ceil(F.col("distance") / step_m), F.lit(2)), F.lit(24)).cast("int")
    s = legs_.where("smooth").withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    u = F.col("i") / F.col("n")
    return s.select("device_id", "i", *[(F.col(c) + (F.col(f"{c}2") - F.col(c)) * u).alias(c) for c in ("t", "x", "y")])


def interpolate(legs_: DataFrame, times: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Position of every device at each of ``times`` (``at``): along smooth legs, else the last fix before.

    Legs and times meet by buckets of time, so a leg is compared with the times of the hours that it spans only.
    """
    of = lambda t: F.floor(t / F.lit(bucket_ms)).cast("long")
    spread = legs_.where("t2 > t").withColumn("bucket", F.explode(F.sequence(of(F.col("t")), of(F.col("t2") - 1))))
    j = spread.join(times.select("at", of(F.col("at")).alias("bucket")), "bucket").where("at >= t and at < t2")
    u = F.when(F.col("smooth"), F.least(F.greatest((F.col("at") - F.col("t")) / (F.col("t2") - F.col("t")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return j.select("device_id", "at", *[(F.col(c) + (F.col(f"{c}2") - F.col(c)) * u).alias(c) for c in ("x", "y")])


def unexported(batch: DataFrame, exported: DataFrame) -> DataFrame:
    """Observations not yet in the store, nulls equal; exporting twice adds nothing."""
    keys = ["entity_id", "attr", "value", "observed_ms", "source"]
    right = exported.select(*[F.col(k).alias(f"x_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"x_{k}"))
    return batch.join(right, same, "left_anti")


def as_of_label(times: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """For each (key, ``at``) the last label (key, ``t``, ``label``) at or before it: union, then one window."""
    both = times.select(key, F.col("at").alias("t"), F.lit(1).alias("ask"), F.lit(None).cast("string").alias("label")).union(labels.select(key, "t", F.lit(0), "label"))
    w = Window.partitionBy(key).orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("label", F.last("label", ignorenulls=True).over(w)).where("ask = 1").select(key, F.col("t").alias("at"), "label")


def islands(series: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """Runs of equal ``flag`` along a series: ``key, flag, first, last, n``."""
    w = Window.partitionBy(key).orderBy(order)
    marked = series.withColumn("flag", flag)
    start = F.coalesce(F.col("flag") != F.lag("flag").over(w), F.lit(True)).cast("int")
    runs = marked.withColumn("start", start).withColumn("run", F.sum("start").over(w))
    return runs.groupBy(key, "run").agg(F.first("flag").alias("flag"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def last_at(index: DataFrame, probes: DataFrame, key: str, time: str, value: str, probe_id: str) -> DataFrame:
    """``probe_id, at, value``: of each probe (``probe_id, key, time``) the last row of ``index`` (``key, time, value``) not after it; null if there is none.

    Both sides are one sorted stream per key, so a probe costs its place in it. Of rows at one time the largest value counts.
    """
    rows = index.where(F.col(time).isNotNull()).groupBy(key, time).agg(F.max(value).alias("value"))
    rows = rows.select(key, F.col(time).alias("t"), F.lit(0).alias("side"), F.struct(F.col(time).alias("at"), "value").alias("row"), F.lit(None).cast(probes.schema[probe_id].dataType).alias(probe_id))
    asked = probes.select(key, F.col(time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), probe_id)
    before = Window.partitionBy(key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.union(asked).withColumn("row", F.last("row", ignorenulls=True).over(before)).where("side = 1")
    return found.select(probe_id, "row.at", "row.value")
