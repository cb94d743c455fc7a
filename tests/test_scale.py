"""Work that must not grow faster than its input: rounds, tasks and passes over cells."""

from pyspark.sql import functions as F

from landloom.operators import spread, wildfire
from landloom.operators import fuelbed as B


def test_a_small_grid_is_solved_in_one_round(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(spread, "checkpointed", lambda df, real=spread.checkpointed: calls.append(1) or real(df))
    cells = spark.range(100 * 100).select(F.floor(F.col("id") / 100).alias("row"), (F.col("id") % 100).alias("col"), F.lit(10.0).alias("ros"), F.lit(1.0).alias("ratio"), F.lit(0.0).alias("facing"))
    times = {(r.row, r.col): r.t for r in spread.arrival_times(cells, 10.0, F.col("row") + F.col("col") == 0).collect()}
    assert abs(times[99, 99] - 99 * 2**0.5) < 1e-6 and abs(times[0, 99] - 99) < 1e-6
    assert len(calls) <= 4  # the tile, and its rim, behind which there are no cells


def test_beds_react_once_per_code(spark, monkeypatch):
    rows = []
    real = B.reaction
    monkeypatch.setattr(B, "reaction", lambda df, prefix="": rows.append(df.count()) or real(df, prefix))
    fuels = B.crown_fuel(spark).withColumn("code", F.lit(1))
    cells = spark.range(50).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("col"), F.lit(1).alias("code"), F.lit(5.0).alias("slope"), F.lit(90.0).alias("aspect"), F.lit(30.0).alias("cc_pct"), F.lit(2.0).alias("cbh_m"), F.lit(0.1).alias("cbd"), (F.col("id") == 0).alias("barrier"))
    found = wildfire.behaviour(cells, fuels, wildfire.Weather()).orderBy("row").collect()
    assert rows == [1, 1] and len(found) == 50
    assert found[0].ros == 0 and not found[0].burnable and found[1].ros > 0 and found[1].burnable


def test_eyes_are_not_joined_to_samples_again(spark):
    from landloom.operators import raster, sight

    grid = raster.Grid(0.0, 100.0, 10.0, 10, 10)
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), F.lit(5.0).alias("v"))
    observers = spark.createDataFrame([(1, 55.0, 45.0, 1.7)], "observer_id long, x double, y double, agl double")
    swept = sight.sweep(observers, cells, grid, azimuths=8, reach=1000.0)
    assert swept._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # the eye's cell and those of the samples
    # four ways along the grid, 4, 5, 5 and 4 steps, and four across it, 6, 7, 6 and 6
    assert swept.count() == swept.where("visible").count() == 43


def test_segments_are_dealt_before_they_are_exploded(spark):
    from landloom.operators import spatial

    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    paths = spark.range(1).select(F.col("id").alias("path_id"), F.array(at(0, 0), at(3000, 4000)).alias("path"))
    points = spark.range(3).select(F.col("id").alias("point_id"), (F.col("id") * 600.0).alias("x"), (F.col("id") * 800.0).alias("y"))
    found = spatial.paths_within(points, paths, "point_id", "path_id", 100.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    explode, deal = plan.rindex("Generate explode(sequence"), plan.rindex("RepartitionByExpression [path_id")
    assert explode < deal  # the lower in the plan comes first
    assert sorted((r.point_id, round(r.distance, 6)) for r in found.collect()) == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_species_of_cells_take_less_than_a_byte_a_row(spark, tmp_path, monkeypatch):
    """The product of cells and species is clustered by code, nothing is left out, and no side is broadcast."""
    from landloom.queries import places

    monkeypatch.setattr(places, "SPREAD", 2, raising=False)
    n, parts = F.col("id"), 200_000
    code = F.when(n < 2000, F.lit(7)).otherwise(n)  # a code with many cells
    spark.range(150_000).select(F.when(n > 0, n).alias("event_id"), code.cast("long").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(parts).select(n.alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    found = places.h24_species_at_cell(spark, str(tmp_path))
    found.write.parquet(f"{tmp_path}/out")
    back, of = spark.read.parquet(f"{tmp_path}/out"), lambda k: len(range(k % 2048, parts, 2048))
    want = sum(of(7 if i < 2000 else i) for i in range(150_000))
    assert back.count() == want and back.where("row is null").count() == of(7)
    assert back.where("row = 500").distinct().count() == sum(of(i) for i in range(32_000, 32_064))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_files_of_species_keep_to_their_dictionaries(spark, tmp_path):
    """A writer whose dictionary is full goes on with 8 bytes a value; copies and nulls of either side count as in a join."""
    import pyarrow.parquet as pq

    from landloom.queries import places

    n, parts = F.col("id"), 400_000
    spark.range(2048 * 16).select(n.alias("event_id"), F.when(n != 5, n).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(parts).select(F.when(n == 7, n + 2048).when(n != 8, n).alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    places.h24_species_at_cell(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    encodings = set()
    for f in (tmp_path / "out").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        encodings |= {e for g in range(meta.num_row_groups) for c in range(3) for e in meta.row_group(g).column(c).encodings}
    assert "PLAIN_DICTIONARY" in encodings and "PLAIN" not in encodings
    back, of = spark.read.parquet(f"{tmp_path}/out"), lambda k: len(range(k % 2048, parts, 2048))
    assert back.count() == sum(of(i) for i in range(2048 * 16)) - of(5) - 16  # less the cell without a code, and the species without a key once a cell
    assert sorted(r.species for r in back.where("row = 0 and col = 7").collect()) == sorted([2055, *range(2055, parts, 2048)])
    assert sorted(r.species for r in back.where("row = 0 and col = 8").collect()) == list(range(2056, parts, 2048))
