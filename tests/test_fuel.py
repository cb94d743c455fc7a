import math

import pytest
from pyspark.sql import functions as F

from landloom.functions import geo, sentences
from landloom.operators import balance, soil
from landloom.operators import fuelbed as B
from landloom.queries import fuel, water
from landloom.session import checkpointed as held


def test_torching_wind_lights_the_crowns(spark, data):
    """At the wind found, intensity is the critical one and crown spread the one that carries fire."""
    cells = B.torching_and_crowning(held(fuel.cells(spark, data)), F.col("cbh"), F.col("cbd"), F.col("fmc"), F.col("slope"))
    ros = B.spread(B.wind_factor(F.col("torching") * B.MPH * B.OPEN_SHARE) + B.slope_factor(F.col("slope")))
    need = F.pow(0.010 * F.col("cbh") * (460 + 25.9 * F.col("fmc")), F.lit(1.5))
    inside = cells.where("torching > 0 and torching <= 120").select(B.fireline_intensity(ros).alias("got"), need.alias("want")).toPandas()
    assert len(inside) > 5
    assert (abs(inside.got / inside.want - 1) < 1e-9).all()
    carried = cells.where("crowning > torching and crowning <= 120").select(B.active_crown_spread(F.col("crowning"), F.col("slope")).alias("got"), (3 / F.col("cbd")).alias("want")).toPandas()
    assert (abs(carried.got / carried.want - 1) < 1e-9).all()
    # a wind of 0 is enough, or none is
    zero = cells.where("torching = 0").select(B.fireline_intensity(B.spread(B.slope_factor(F.col("slope")))).alias("got"), need.alias("want")).toPandas()
    assert (zero.got >= zero.want * (1 - 1e-9)).all()
    never = cells.where(F.col("torching") == float("inf")).select(B.fireline_intensity(B.spread(B.wind_factor(F.lit(B.MAX_WIND * B.MPH * B.OPEN_SHARE)) + B.slope_factor(F.col("slope")))).alias("got"), need.alias("want")).toPandas()
    assert (never.got < never.want).all()


def test_spread_grows_with_wind_until_its_limit(spark, data):
    winds = [0.0, 5.0, 20.0, 80.0, 5000.0, 6000.0]
    ros = held(fuel.cells(spark, data)).where("base_ros > 0").select(*[B.spread(B.wind_factor(F.lit(w) * B.MPH)).alias(f"r{i}") for i, w in enumerate(winds)]).toPandas()
    assert len(ros)
    for i in range(len(winds) - 1):
        assert (ros[f"r{i}"] <= ros[f"r{i + 1}"] + 1e-12).all()
    assert (ros.r4 == ros.r5).all()


def test_unknown_and_empty_beds_do_not_burn(spark, data):
    fuels = fuel.fuels(spark, data).withColumn("dead_1h", F.lit(0.0))
    for k in B.CLASSES[1:]:
        fuels = fuels.withColumn(k, F.lit(0.0))
    m = [F.lit(0.05).alias(f"m_{k}") for k in B.CLASSES]
    cells = spark.createDataFrame([(1, 1), (2, 999), (3, None)], "id int, code long").select("id", "code", *m)
    beds = B.with_fuel(cells, B.beds(fuels)).withColumn("burns", F.coalesce("burns", F.lit(False)))
    assert [tuple(r) for r in B.reaction(beds).select("reaction", "base_ros").collect()] == [(0.0, 0.0)] * 3
    assert B.reaction(beds.limit(0)).count() == 0


def test_wet_dead_fuel_does_not_burn(spark):
    crown = B.beds(B.crown_fuel(spark))
    at = lambda v: B.reaction(crown.select("*", *[F.lit(v).alias(f"m_{k}") for k in B.CLASSES])).select("reaction").first()[0]
    assert at(0.05) > at(0.15) > at(0.24) > 0
    assert at(0.25) == at(0.9) == 0


def test_sentences_say_nothing_of_nulls(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(sentences.fire_sentences(none.cast("string"), none, none, none, none, none, none, none, none).alias("none"), sentences.fire_sentences(none.cast("string"), none, F.lit(12.4), F.lit(200.0), none, none, none, F.lit(2), none).alias("some")).first()
    assert row.none == []
    assert row.some == [sentences.TEXT["slope"] % "12 m/min", sentences.TEXT["arrival"] % "3.3 hr", sentences.TEXT["crown_2"]]


def test_balance_of_regions_without_samples_or_years(spark):
    samples = spark.createDataFrame([("a", 100.0), ("a", None), ("b", 300.0)], "region string, aet double")
    annual = spark.createDataFrame([("b", 2020, 900.0, 1.0, 50.0, None), ("b", 2021, 800.0, 2.0, 40.0, 5.0), ("c", 2021, 700.0, 3.0, 30.0, 4.0)], "region string, year int, precip_mm double, aet_mm double, runoff_mm double, recharge_mm double")
    got = {r.region: r for r in balance.region_balance(samples, annual, "region", F.lit(2000.0)).collect()}
    assert (got["a"].aet_mm, got["a"].year, got["a"].aet_m3, got["a"].n_samples) == (100.0, None, 200.0, 1)
    assert (got["b"].aet_mm, got["b"].year, got["b"].precip_m3) == (300.0, 2021, 1600.0)
    assert (got["c"].aet_mm, got["c"].n_samples) == (3.0, 0)
    assert balance.region_balance(samples.limit(0), annual.limit(0), "region", F.lit(1.0)).count() == 0


def test_short_paths_are_refused(spark):
    path = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y")) for x in (1.0, 1.0001)])
    with pytest.raises(Exception, match="a path needs 2 to 100000 points and has 1"):
        spark.range(1).select(geo.normal_path(path).alias("p")).collect()


def test_seep_sites_equal_the_greedy_loop(spark, data):
    cells = water.seep_cells(spark, data)
    chosen = []
    for r in sorted(cells.where("score >= 55").collect(), key=lambda r: (-r.score, r.id)):
        if len(chosen) < 8 and all(math.hypot(r.x - c.x, r.y - c.y) >= 30 for c in chosen):
            chosen.append(r)
    assert sorted(r.id for r in soil.seep_sites(cells).collect()) == sorted(c.id for c in chosen)


def test_results_can_be_filtered(spark, data):
    """A filter on a result plans and runs at once; its columns are not copied into it."""
    import time

    began = time.monotonic()
    t = B.torching_and_crowning(fuel.cells(spark, data), F.col("cbh"), F.col("cbd"), F.col("fmc"), F.col("slope"))
    assert t.where("torching < 10").count() == sum(r.torching is not None and r.torching < 10 for r in t.select("torching").collect())
    assert time.monotonic() - began < 30
