"""Properties of the newer operators on small made inputs."""

import math

import pytest
from pyspark.sql import functions as F

from landloom.functions import fire, labels, sky
from landloom.operators import filters, layers, sites, soil, stems
from landloom.operators.raster import Grid

GRID = Grid(x0=0.0, y0=40.0, size=10.0, width=4, height=4)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_level_surface_holds_the_volume(spark):
    ground = [("a", 1.0, 2.0), ("a", 1.5, 1.5), ("a", 2.5, 0.5), ("b", 4.0, 1.0), ("b", 4.0, 1.0)]
    cells = spark.createDataFrame(ground, "label string, v double, depth double")
    volumes = spark.createDataFrame([("a", 130.0), ("b", 9000.0)], "label string, volume double")
    level = {r.label: r.level for r in soil.level_surface(cells, volumes, 100.0).collect()}
    held = sum(min(max(level["a"] - v, 0), d) for la, v, d in ground if la == "a") * 100
    assert held == pytest.approx(130.0) and level["b"] == pytest.approx(5.0)
    assert soil.level_surface(cells, volumes.where("volume < 0"), 100.0).count() == 0


def test_voids_take_the_smallest_reach(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 5, 9.0)], "row long, col long, v double")
    gap = spark.createDataFrame([(0, 1), (0, 3), (9, 9)], "row long, col long")
    got = {(r.row, r.col): r.v for r in stems.fill_voids(cells, gap, (1, 3)).collect()}
    assert got[(0, 1)] == 1.0 and got[(0, 3)] == pytest.approx((1 / 3 + 9 / 2) / (1 / 3 + 1 / 2)) and (9, 9) not in got


def test_region_samples_fall_back_to_the_centre(spark):
    thin = filters.region({"polygon": [[(0, 0), (10, 0), (10, 0.01), (0, 0.01)]]})
    got = layers.samples(spark, thin, 4).collect()
    assert [(round(r.x, 3), round(r.y, 3)) for r in got] == [(5.0, 0.005)] or all(0 <= r.y <= 0.01 for r in got)


def test_boxes_meet_once(spark):
    box = lambda a, b, c, d: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((a, b, c, d), ("min_x", "min_y", "max_x", "max_y"))])
    left = spark.range(1).select(F.lit("l").alias("l"), box(0, 0, 35, 35).alias("box"))
    right = spark.range(1).select(F.lit("r").alias("r"), box(-5, 5, 25, 90).alias("rbox"))
    far = spark.range(1).select(F.lit("q").alias("r"), box(36, 0, 40, 9).alias("rbox"))
    assert [(x.l, x.r) for x in layers.box_pairs(left, right.union(far), 10.0).collect()] == [("l", "r")]


def test_missing_values_in_labels(spark):
    nothing = F.lit(None).cast("string")
    r = one(spark, labels.device_key(nothing), labels.utc_millis(F.lit("2024-01-01T00:00:00")), labels.utc_millis(F.lit("2024-01-01T02:00:00.9+02:00")), labels.flow_hectares(F.lit(5.0), nothing, F.lit(1.0)), labels.node_id(F.lit("99999999999")), sites.drainage(nothing, nothing))
    assert list(r) == ["", None, 1704067200000, None, "99999999999", 0.5]


def test_fire_limits(spark):
    dead = fire.dead_moisture(F.lit(70.0), F.lit(20.0), F.lit(0.0))
    r = one(spark, *dead.values(), fire.foliar_moisture(F.lit(45.0), F.lit(100.0), F.lit(500.0), F.lit(300.0), "catastrophic"), fire.midflame_wind(F.lit(-3.0), F.lit(None).cast("double")))
    assert [round(v, 6) for v in r] == [0.35, 0.35, 0.3, 110.0, 0.0]
    assert fire.ember_reach(0.5, 9.0, True, True) == 0.0 and fire.ember_reach(100.0, 3.0, False, True) == 800.0


def test_embers_fly_downwind_only(spark):
    cells = spark.range(81).select(F.floor(F.col("id") / 9).cast("long").alias("row"), (F.col("id") % 9).alias("col"))
    cells = cells.withColumn("source", (F.col("row") == 4) & (F.col("col") == 4)).withColumn("burned", F.col("source"))
    got = layers.embers(cells, 10.0, 30.0, 0.0, 22.5).collect()
    assert {(r.row, r.col) for r in got} == {(3, 4), (2, 4), (1, 4)}
    assert layers.embers(cells, 10.0, 0.0, 0.0, 22.5).count() == 0


def test_night_has_no_sun(spark):
    r = one(spark, sky.clear_sky(F.lit(-5.0), 0.0, F.lit(100)).alias("n"), sky.clear_sky(F.lit(60.0), 0.0, F.lit(100)).alias("d"))
    assert tuple(r.n) == (0.0, 0.0, 0.0)
    assert r.d.ghi == pytest.approx(r.d.dni * math.sin(math.radians(60)) + r.d.dhi) and 700 < r.d.ghi < 1100


def test_canopy_keeps_the_taller_crown(spark):
    rows = spark.createDataFrame([(15.0, 25.0, 12.0, 5.0), (15.0, 25.0, 1.0, 9.0), (500.0, 25.0, 1.0, 9.0)], "x double, y double, radius double, height double")
    got = {(r.row, r.col): r.v for r in layers.canopy(rows, GRID).collect()}
    assert got == {(1, 1): 9.0, (0, 1): 5.0, (2, 1): 5.0, (1, 0): 5.0, (1, 2): 5.0}


def test_node_ids_of_keys_over_32_bits_equal_their_sql(spark, tmp_path):
    import duckdb

    from landloom import queries

    spark.range(542_300, 542_900, 1, 1).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = {tuple(r) for r in queries.queries()["g07_node_id"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(queries.oracles()["g07_node_id"]).fetchall())
