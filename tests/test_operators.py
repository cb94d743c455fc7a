"""Laws and brute force for what SQL does not express, and round trips of sources and streams."""

import gzip
import heapq
import json
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom import queries
from landloom import views as V
from landloom.functions import geo
from landloom.operators import filters, raster, sites, spatial, spread, store
from landloom.operators import telemetry as T
from landloom.plans import edits as E
from landloom.plans.revisions import Plans
from landloom.sources import files, journal, sqlite
from landloom.streaming import telemetry as S


def heap_flood(z):
    n, m = z.shape
    w = np.full((n, m), np.inf)
    heap = []
    for r in range(n):
        for c in range(m):
            if r in (0, n - 1) or c in (0, m - 1):
                w[r, c] = z[r, c]
                heapq.heappush(heap, (w[r, c], r, c))
    while heap:
        v, r, c = heapq.heappop(heap)
        for dr, dc in raster.NEIGHBOURS:
            i, j = r + dr, c + dc
            if 0 <= i < n and 0 <= j < m and w[i, j] == np.inf:
                w[i, j] = max(v, z[i, j])
                heapq.heappush(heap, (w[i, j], i, j))
    return w


def cells(spark, z):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(z) for c, v in enumerate(row)], "row long, col long, v double")


def test_fill_equals_heap_flood(spark):
    z = np.random.default_rng(0).integers(0, 50, (40, 37)).astype(float)
    got = {(r.row, r.col): r.filled for r in spread.fill_depressions(cells(spark, z)).collect()}
    want = heap_flood(z)
    assert all(got[r, c] == want[r, c] for r in range(40) for c in range(37))


def test_arrival_equals_dijkstra(spark):
    rng = np.random.default_rng(1)
    ros, ratio, facing = rng.uniform(0, 5, (35, 35)), rng.uniform(1, 4, (35, 35)), rng.uniform(0, 360, (35, 35))
    ros[rng.random((35, 35)) < 0.15] = 0
    ros[3, 4] = 2
    t = np.full((35, 35), np.inf)
    t[3, 4], heap = 0, [(0.0, 3, 4)]
    while heap:
        v, r, c = heapq.heappop(heap)
        for dr, dc in raster.NEIGHBOURS:
            i, j = r + dr, c + dc
            if v <= t[r, c] and 0 <= i < 35 and 0 <= j < 35 and ros[i, j] > 0 and ros[r, c] > 0:
                e = math.sqrt(1 - 1 / ratio[r, c] ** 2)
                s = ros[r, c] * (1 - e) / (1 - e * math.cos(math.atan2(dc, -dr) - math.radians(facing[r, c])))
                if v + 10 * math.hypot(dr, dc) / s < t[i, j] - 1e-12:
                    t[i, j] = v + 10 * math.hypot(dr, dc) / s
                    heapq.heappush(heap, (t[i, j], i, j))
    rows = [(r, c, float(ros[r, c]), float(ratio[r, c]), float(facing[r, c])) for r in range(35) for c in range(35)]
    df = spark.createDataFrame(rows, "row long, col long, ros double, ratio double, facing double")
    for x in spread.arrival_times(df, 10.0, (F.col("row") == 3) & (F.col("col") == 4)).collect():
        assert x.t == t[x.row, x.col] or abs(x.t - t[x.row, x.col]) < 1e-6


def test_spaced_equals_the_greedy_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(rng.integers(0, 60, (400, 3)))]
    kept = []
    for i, x, y, s in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 81 for _, a, b in kept):
            kept.append((i, x, y))
    df = spark.createDataFrame(rows, "id long, x double, y double, score double")
    got = [r.id for r in spatial.spaced(df, "score", 15, 9.0).orderBy("rank").collect()]
    assert got == [k[0] for k in kept[:15]]
    assert spatial.spaced(df.limit(0), "score", 5, 9.0).count() == 0


def test_queries_without_sql_return_rows(spark, data):
    for name in sorted(set(queries.queries()) - set(queries.oracles())):
        assert queries.queries()[name](spark, data).count() > 0


def test_find_count_equals_aggregate(spark, data):
    e, r = V.entities(spark, data), filters.region({"bbox": [-1000, -1000, 1000, 1000]})
    found = store.find(e, V.observations(spark, data), "customer", r, (0.0, 0.0), limit=5).collect()
    assert found[0].total == e.where("kind = 'customer'").where(r.holds(F.col("x"), F.col("y"))).count()
    assert [x.distance for x in found] == sorted(x.distance for x in found)


def test_observing_twice_adds_nothing(spark, data):
    o = V.observations(spark, data)
    assert store.changed_only(store.latest(o).select(o.columns), o).count() == 0


def test_filters():
    f = filters.parse_filter("height >= 12.5")
    assert (f.attr, f.op, f.value) == ("height", ">=", 12.5)
    assert filters.parse_filter("type='x y'").value == "x y" and filters.parse_filter("a == 5").value == "= 5"
    for bad in ("height", "> 3", ""):
        with pytest.raises(filters.QueryError):
            filters.parse_filter(bad)
    with pytest.raises(filters.QueryError):
        filters.region({"bbox": [0, 0, 1, 1], "aoi": True})
    assert filters.region({"polygon": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]]}).area == 15
    assert filters.normalise_constraint({"field": "a", "values": [1]}) == {"signal": "a", "op": "in", "value": [1]}


def test_missing_values_fail_every_filter(spark):
    df = spark.createDataFrame([("5",), (None,), ("x",)], "v string")
    for op, n in (("=", 1), ("!=", 0), (">", 0), ("<=", 1)):
        assert df.where(filters.parse_filter(f"v {op} 5").on(F.col("v"))).count() == n


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    hole = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))])
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((6, 0), (6, 9))])
    at = lambda x, y: (F.lit(x), F.lit(y))
    r = spark.range(1).select(
        geo.in_polygon(*at(1.5, 1.5), F.array(ring, hole)), geo.in_polygon_with_holes(*at(3.0, 3.0), F.array(ring, hole)), geo.polygon_area(F.array(ring, hole)), geo.polygon_area(F.array(ring, hole), False),
        geo.path_distance(*at(9.0, 3.0), line), geo.path_path_distance(ring, line), geo.nearest_on_path(*at(9.0, 3.0), line)["y"], F.size(geo.path_samples(line, F.lit(3.0))),
    ).first()
    assert tuple(r) == (False, True, 15.0, 17.0, 3.0, 2.0, 3.0, 4)


def test_utm_round_trip_is_a_tenth_of_a_millimetre(spark):
    df = spark.createDataFrame([(-105.0 + i / 3, 10.0 * i) for i in range(-5, 8)], "lon double, lat double")
    u = df.select("lon", "lat", geo.to_utm(F.col("lon"), F.col("lat"), 13).alias("u"))
    for r in u.select("lon", "lat", "u", geo.from_utm(F.col("u.e"), F.col("u.n"), 13).alias("g")).collect():
        assert abs(r.g.lon - r.lon) < 1e-9 and abs(r.g.lat - r.lat) < 1e-9
    one = df.limit(1).select(geo.to_utm(F.lit(-105.0), F.lit(40.0), 13).alias("u")).first().u
    assert abs(one.e - 500000) < 1e-6 and abs(one.n - 4427757.2187) < 1e-3


def test_site_profiles_and_unknown_objective(spark):
    some = spark.createDataFrame([(1, 10.0, 0.5), (2, 20.0, 0.5)], "id long, elevation double, low_slope double")
    with pytest.raises(filters.QueryError):
        sites.score(some, "overlook")
    df = some.withColumns({"prominence": F.col("elevation") * 0, "openness": F.col("elevation"), "dryness": F.lit(None).cast("double")})
    assert [round(r.score, 4) for r in sites.score(df, "overlook").orderBy("id").collect()] == [0.225, 0.675]
    with pytest.raises(filters.QueryError):
        sites.score(df, "moon")


def test_times_need_a_zone(spark):
    rows = [("2024-01-01T00:00:00Z", 1704067200000), ("2024-01-01T02:00:00.9+02:00", 1704067200000), ("2024-01-01T00:00:00", None), ("x", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want long").select(T.parse_time(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_plans_commit_branch_and_conflict(spark, tmp_path):
    p = Plans(spark, f"file://{tmp_path}/plans")
    a = p.commit("p", None, [{"kind": "terrain_cut", "x": 1, "y": 2}])
    b = p.commit("p", a, [{"kind": "orchard", "x": 1, "y": 2, "params": {"r": 9999}}])
    with pytest.raises(filters.QueryError):
        p.commit("p", a, [])
    assert p.branch("p", "q") == b and p.head("q") == b
    assert p.edits(b).first().r == E.MAX_RADIUS
    assert [r.id for r in store.ancestry(p.nodes(), b).orderBy("depth").collect()] == [b, a]
    with pytest.raises(filters.QueryError):
        E.normalise([{"kind": "volcano", "x": 0, "y": 0}])
    assert E.canonical({"b": 1.0, "a": [2.5]}) == '{"a":[2.5],"b":1}'


def test_journal_replay(spark, tmp_path):
    ops = [
        {"op": "run", "run_id": 1, "script": "a", "started_at": "t0"}, {"op": "entity", "entity_id": "tree:1", "kind": "tree", "run_id": 1, "created_at": "t0"}, {"op": "obs", "entity_id": "tree:1", "attr": "height", "value": "5", "run_id": 1},
        {"op": "meta", "key": "k", "value": "1"}, {"op": "finish_run", "run_id": 1, "finished_at": "t1"}, {"op": "retire", "entity_id": "tree:1", "run_id": 2, "retired_at": "t2"},
    ]
    path = f"file://{tmp_path}/journal"
    journal.append(spark.createDataFrame([tuple(o.get(f.split()[0]) for f in journal.OPS.replace("\n", " ").split(", ")) for o in ops], journal.OPS), path, "first")
    more = [{"op": "unretire", "entity_id": "tree:1"}, {"op": "meta", "key": "k", "value": "2"}]
    with gzip.open(f"{tmp_path}/journal/000002-more.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, more)))
    t = journal.replay(journal.read(spark, path + "/*.jsonl.gz"))
    assert [(r.entity_id, r.kind, r.retired_run_id) for r in t["entities"].collect()] == [("tree:1", "tree", None)]
    assert [(r.key, r.value) for r in t["meta"].collect()] == [("k", "2")]
    assert t["runs"].first().finished_at == "t1" and t["observations"].count() == 1


def test_grid_and_geojson_and_climate(spark, tmp_path):
    g = {"width": 2, "height": 2, "heights": [1, 2, None, 4], "minX": 0, "maxX": 10, "minY": 0, "maxY": 10, "outerMinX": -5, "outerMaxX": 15, "outerMinY": -5, "outerMaxY": 15, "minElevation": 1, "maxElevation": 9}
    (tmp_path / "grid.json").write_text(json.dumps(g))
    assert [(r.row, r.col, r.v) for r in files.read_grid(spark, f"{tmp_path}/grid.json").orderBy("row", "col").collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 4.0)]
    assert [r.problem for r in files.grid_problems(spark, f"{tmp_path}/grid.json").collect()] == ["highest height differs"]
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"type": "Feature", "properties": None, "geometry": {"type": "Point", "coordinates": [3, 4]}}]}
    (tmp_path / "v.geojson").write_text(json.dumps(fc, indent=1))
    got = files.read_geojson(spark, f"{tmp_path}/v.geojson").orderBy("fid").collect()
    assert [r.kind for r in got] == ["Polygon", "Point"] and len(got[0].parts[0]) == 4 and got[1].parts[0][0].y == 4.0 and json.loads(got[0].properties) == {"a": 1}
    (tmp_path / "c.csv").write_text("year,yday,prcp (mm/day),tmax (deg c)\n2023,1,0.5,3\n2023,365,1,4\n")
    c = files.read_climate(spark, f"{tmp_path}/c.csv").orderBy("yday").collect()
    assert [str(r.day) for r in c] == ["2023-01-01", "2023-12-31"] and c[0].prcp == 0.5


def test_sqlite_source(spark, tmp_path):
    path = f"{tmp_path}/t.gpkg"
    with sqlite3.connect(path) as con:
        con.execute("create table trees (fid integer primary key, name text, geom blob)")
        con.executemany("insert into trees values (?, ?, ?)", [(i, f"t{i}", sqlite.point_blob(i, -i)) for i in range(1, 26)])
    spark.dataSource.register(sqlite.SqliteSource)
    df = spark.read.format("landloom_sqlite").option("table", "trees").option("rowsPerTask", 10).load(path)
    assert df.rdd.getNumPartitions() == 3
    p = df.select("fid", sqlite.gpkg_point(F.col("geom")).alias("p"))
    assert all((r.p.x, r.p.y) == (r.fid, -r.fid) for r in p.collect())


def test_streams(spark, tmp_path):
    rows = [(1, "d1", "position", "2024-01-01T00:00:00Z", 1.0, 2.0), (2, "d1", "data", "2024-01-01T00:01:00Z", None, None), (3, "d2", "junk", "2024-01-01T00:01:00Z", None, None), (4, "d2", "status", "2024-01-01T00:05:00", None, None), (5, "d2", "status", "2024-01-01T00:30:00Z", None, None)]
    src = tmp_path / "in"
    src.mkdir()
    for i, r in enumerate(rows):
        (src / f"{i}.json").write_text(json.dumps(dict(zip(("id", "device_id", "kind", "observed_at", "lat", "lon"), r))))
    e = S.events(spark, f"{src}", files_per_batch=2)
    S.store(e, f"{tmp_path}/store", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/store/events").count() == 3 and spark.read.parquet(f"{tmp_path}/store/dead").count() == 2
    S.latest_state(e, f"{tmp_path}/state", f"{tmp_path}/c2").awaitTermination()
    versions = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir())
    state = {r.device_id: r for r in spark.read.parquet(f"{tmp_path}/state/version={versions[-1]}").collect()}
    assert state["d1"].kind == "data" and state["d1"].lat == 1.0 and state["d1"].position_ms == 1704067200000 and state["d2"].id == 5
    q = S.counts(e).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("counted").collect()) == 3


def test_ancestry_of_any_depth(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(1000)]
    nodes = spark.createDataFrame(chain + [("x", "y"), ("y", "x"), ("z", "gone")], "id string, parent string")
    found = store.ancestry(nodes, "999").orderBy("depth").collect()
    assert [(r.depth, r.id) for r in found] == [(d, str(999 - d)) for d in range(1000)]
    assert {r.id for r in store.ancestry(nodes, "x").collect()} == {"x", "y"}
    assert [r.id for r in store.ancestry(nodes, "z").collect()] == ["z"] and store.ancestry(nodes, "none").count() == 0


def test_cover_and_soil_features_fit_the_profiles(spark):
    df = spark.createDataFrame([(1, "Oak forest", "A", "well drained"), (2, "Marsh", "D", "poorly drained")], "id long, cover string, hsg string, words string")
    rest = {f: F.lit(0.5) for p in sites.PROFILES.values() for f in p}
    df = df.withColumns(rest | sites.cover_scores(F.col("cover")) | {"soil_drainage": sites.drainage(F.col("hsg"), F.col("words"))})
    for objective in sites.PROFILES:
        one, two = (r.score for r in sites.score(df, objective).orderBy("id").collect())
        assert (one > two) == (objective in ("trailcam", "garden", "structure"))


def test_as_of_without_a_nested_loop(spark):
    rows = [(1, "e", "a", "x", 10), (2, "e", "a", "y", 20), (3, "e", "a", "z", 20), (4, "f", "a", "w", 15)]
    o = spark.createDataFrame(rows, "obs_id long, entity_id string, attr string, value string, run_id long")
    runs = spark.createDataFrame([(5,), (10,), (12,), (20,), (30,)], "run_id long")
    got = {(r.run_id, r.entity_id, r.value) for r in store.as_of(o, runs).collect()}
    assert got == {(10, "e", "x"), (12, "e", "x"), (20, "e", "z"), (30, "e", "z"), (20, "f", "w"), (30, "f", "w")}


def test_spaced_in_small_batches_equals_the_greedy_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(rng.integers(0, 60, (500, 3)))]
    kept = []
    for i, x, y, s in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 81 for _, a, b in kept):
            kept.append((i, x, y))
    df = spark.createDataFrame(rows + [(999, None, 1.0, 99.0)], "id long, x double, y double, score double")
    assert [r.id for r in spatial.spaced(df, "score", 1000, 9.0, batch=16).orderBy("rank").collect()] == [k[0] for k in kept]


def test_an_edit_of_too_many_plants_is_refused(spark):
    spec = "edit_id string, kind string, x double, y double, r double"
    small, large = ("a", "orchard", 0.0, 0.0, 20.0), ("b", "orchard", 0.0, 0.0, 500.0)
    assert E.plantings(spark.createDataFrame([small], spec), 5.0).count() > 0
    with pytest.raises(Exception, match="edit_too_large: b"):
        E.plantings(spark.createDataFrame([small, large], spec), 5.0).collect()


def test_spread_over_many_small_tiles_equals_one_tile(spark):
    """Rounds solve only the tiles next to a changed rim; a winding valley sends the front back into tiles it has left."""
    rng = np.random.default_rng(9)
    z = rng.integers(0, 9, (17, 23)).astype(float)
    rows = [(r, c, float(z[r, c]), 1.0, 0.0, float(z[r, c]) if r in (0, 16) or c in (0, 22) else float("inf")) for r in range(17) for c in range(23)]
    df = spark.createDataFrame(rows, "row long, col long, cost double, ratio double, facing double, t double")
    found = [sorted(map(tuple, spread.spread(df, "fill", tile=t).collect())) for t in (3, 5, 64)]
    assert found[0] == found[1] == found[2]
