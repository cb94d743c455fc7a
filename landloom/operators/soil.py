"""Soil hydraulics: infiltration, drainage and texture as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions.geo import bind

from .spatial import spaced


def texture(sand: Column, silt: Column, clay: Column) -> Column:
    """USDA texture class, by the triangle's boundaries in order."""
    s, i, c = sand, silt, clay
    return (
        F.when(i + 1.5 * c < 15, "sand").when(i + 2 * c < 30, "loamy sand").when((c >= 40) & (s <= 45) & (i < 40), "clay").when((c >= 40) & (i >= 40), "silty clay")
        .when((c >= 35) & (s > 45), "sandy clay").when((c >= 27) & (s <= 20), "silty clay loam").when((c >= 27) & (s <= 45), "clay loam").when((c >= 20) & (i < 28) & (s > 45), "sandy clay loam")
        .when((i >= 80) & (c < 12), "silt").when(i >= 50, "silt loam").when((c >= 7) & (i >= 28) & (s <= 52), "loam").otherwise("sandy loam")
    )


def green_ampt(before: Column, ksat: Column, suction_deficit: Column, hours: Column, supply: Column) -> Column:
    """Infiltration of a time step in mm: F - S ln((F + S)/(F0 + S)) = F0-consistent capacity K dt, found by 32 halvings,
    and never more than the supply."""

    def capacity(s: Column) -> Column:
        def halve(acc: Column, _) -> Column:
            def pick(mid: Column) -> Column:
                left = mid - s * F.log((before + mid + s) / (before + s))
                return F.when(left < ksat * hours, F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

            return bind((acc["lo"] + acc["hi"]) / 2, pick)

        top = ksat * hours + F.sqrt(2 * ksat * hours * s) + s + 1
        start = F.struct(F.lit(0.0).alias("lo"), top.cast("double").alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda a: (a["lo"] + a["hi"]) / 2)

    deep = F.when(ksat <= 0, 0.0).when(suction_deficit <= 0, ksat * hours).otherwise(capacity(suction_deficit))
    return F.least(deep, supply)


def brooks_corey(storage: Column, room: Column, ksat: Column, pore_index: Column, hours: Column) -> Column:
    """Gravity drainage of a step in mm from ``storage`` of ``room``: dS/dt = -K (S/room)^m with m = 3 + 2/index, solved exactly."""
    m = 3 + 2 / pore_index
    s = F.least(F.greatest(storage / room, F.lit(0.0)), F.lit(1.0))
    after = F.when(s > 0, F.pow(F.pow(s, 1 - m) + (m - 1) * ksat * hours / room, 1 / (1 - m))).otherwise(0.0)
    return F.greatest((s - after) * room, F.lit(0.0))


def root_zone_water(horizons: Column, depth_cm: float = 70.0, limit_cm: Column | None = None, storage_150_cm: Column | None = None) -> Column:
    """Available water in mm down to a depth or a shallower restriction, from ``array<struct<top, bottom, awc>>``.

    Horizons with a missing part are left out; where none is left, the map unit's storage of the first 150 cm counts by share.
    """
    deep = F.lit(float(depth_cm)) if limit_cm is None else F.greatest(F.least(F.coalesce(limit_cm, F.lit(float(depth_cm))), F.lit(float(depth_cm))), F.lit(0.0))
    known = F.filter(F.coalesce(horizons, F.array()), lambda h: h["top"].isNotNull() & h["bottom"].isNotNull() & h["awc"].isNotNull() & (F.least(h["bottom"], deep) > F.greatest(h["top"], F.lit(0.0))))
    part = F.transform(known, lambda h: (F.least(h["bottom"], deep) - F.greatest(h["top"], F.lit(0.0))) * F.greatest(h["awc"], F.lit(0.0)) * 10)
    total = F.aggregate(part, F.lit(0.0), lambda s, v: s + v)
    if storage_150_cm is None:
        return total
    return F.when(F.size(known) > 0, total).otherwise(F.greatest(storage_150_cm, F.lit(0.0)) * F.least(deep, F.lit(150.0)) / 150 * 10)


def profile_ksat(horizons: DataFrame) -> DataFrame:
    """Per map unit (``mukey, pct, top, bottom, ksat, awc``): of the dominant component the least conductivity, the mean
    weighted by thickness where conductive, and the water held."""
    top = horizons.groupBy("mukey").agg(F.max("pct").alias("best"))
    h = horizons.join(top, "mukey").where("pct = best").withColumn("thick", F.col("bottom") - F.col("top"))
    wet = F.col("ksat") > 0.05
    return h.groupBy("mukey").agg(
        F.min("ksat").alias("ksat_min"), (F.sum(F.when(wet, F.col("ksat") * F.col("thick"))) / F.sum(F.when(wet, F.col("thick")))).alias("ksat_mean"), F.sum(F.col("awc") * F.col("thick") * 10).alias("taw_mm")
    )


def peaking_factor(hours: Column) -> Column:
    """Ratio of peak to mean discharge of a storm, by its length."""
    return F.when(hours <= 3, 3.5).when(hours <= 12, 2.5).when(hours <= 24, 2.0).otherwise(1.5)


def antecedent_class(wetness: Column) -> Column:
    return F.when(wetness < 0.33, "dry").when(wetness > 0.67, "wet").otherwise("normal")


def seep_score(wetness_pct: Column, flow_pct: Column, break_pct: Column, restriction_cm: Column, ksat_min: Column) -> Column:
    """Spring and seep score of 0 to 100: wetness, flow, slope break and a shallow restrictive layer. Slow soils of unknown depth
    count as 60 cm."""
    depth = F.coalesce(restriction_cm, F.when(ksat_min < 5, 60.0))
    shallow = F.coalesce(F.least(F.greatest(1 - depth / 150, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return 40 * zero(wetness_pct) + 20 * zero(flow_pct) + 15 * zero(break_pct) + 25 * shallow


def level_surface(cells: DataFrame, volumes: DataFrame, area: float) -> DataFrame:
    """``label, level`` of the water in each depression that holds ``volume`` m3 (at most its capacity).

    ``cells`` has ``label, v, depth``: ground and how deep water can stand. Over rising levels a cell adds its area from its
    ground on and no more from ``v + depth`` on, so the volume is a sum of ramps: two events a cell, running sums, and the
    level lies in the segment where the volume is reached.
    """
    up = cells.where("depth > 0").select("label", F.col("v").alias("at"), F.lit(1).alias("n"))
    down = cells.where("depth > 0").select("label", (F.col("v") + F.col("depth")).alias("at"), F.lit(-1).alias("n"))
    steps = up.union(down).groupBy("label", "at").agg(F.sum("n").alias("n"))
    by_level = Window.partitionBy("label").orderBy("at")
    wet = steps.select("label", "at", F.sum("n").over(by_level).alias("wet"), F.lead("at").over(by_level).alias("next"))
    part = F.coalesce((F.col("next") - F.col("at")) * F.col("wet") * area, F.lit(0.0))
    sums = wet.select("label", "at", "wet", "next", (F.sum(part).over(by_level) - part).alias("below"), F.sum(part).over(by_level).alias("above"))
    held = sums.join(volumes.where("volume > 0").select("label", "volume"), "label").where("wet > 0")
    hit = held.where((F.col("below") < F.col("volume")) & (F.col("above") >= F.col("volume")))
    full = held.groupBy("label").agg(F.max("next").alias("top"), F.max("above").alias("capacity"), F.first("volume").alias("volume")).where("volume > capacity")
    level = F.col("at") + (F.col("volume") - F.col("below")) / (F.col("wet") * area)
    return hit.select("label", level.alias("level")).union(full.select("label", "top"))


def seep_sites(cells: DataFrame, n: int = 8, least: float = 55.0, gap: float = 30.0) -> DataFrame:
    """The ``n`` best cells (``id, x, y, score``) that score ``least`` or more, ``gap`` metres apart, as a greedy choice takes them."""
    return spaced(cells.where(F.col("score") >= least), "score", n, gap)
