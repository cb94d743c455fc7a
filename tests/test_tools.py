"""Packets of many dialects, time indexes, building clearance against a loop, table functions in SQL."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.operators import packets, stems, tools
from landloom.operators import telemetry as T
from landloom.operators.raster import Grid


def test_packets_of_many_dialects(spark):
    said = [
        {"fromId": "!0a0B0c0D", "rxTime": 1700000000.9, "decoded": {"position": {"latitude": "40.5", "longitude": -105, "altitude": 1650}}},
        {"from": 255, "decoded": {"position": {"latitudeI": 405000000, "longitudeI": "-1050000000", "ground_track": 9000000}}},
        {"from": 255, "decoded": {"position": {"latitude": 1, "ground_track": 720}, "user": {"id": "!ff", "long_name": " "}}},
        {"from": "x1", "hopStart": 3, "hopLimit": 5, "decoded": {"text": "hi", "telemetry": {}}},
        {"decoded": {"telemetry": {"device_metrics": {"battery_level": "nan"}}}},
        {"from": 1, "decoded": {"portnum": "ADMIN_APP", "a": 1}}, {"from": 1, "decoded": {"portnum": "OTHER", "a": 1}}, {"from": 1}, {"from": 7, "decoded": {"text": "me"}}, [1], None,
    ]
    rows = [(i, None if x is None else json.dumps(x)) for i, x in enumerate(said)] + [(90, "{bad"), (91, "")]
    got = {r.id: r for r in packets.events(spark.createDataFrame(rows, "id int, packet string"), gateway="!00000007").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6]
    assert [got[i].kind for i in sorted(got)] == ["position", "position", "status", "message", "status", "data"]
    assert [got[i].device_id for i in sorted(got)] == ["!0a0b0c0d", "!000000ff", "!000000ff", "x1", "unknown", "!00000001"]
    assert (got[0].observed_ms, got[0].lat, got[0].lon, got[0].altitude) == (1700000000000, 40.5, -105.0, 1650.0)
    assert (got[1].lat, got[1].heading) == (40.5, 90.0) and got[2].label == "!ff" and got[2].lat is None
    assert (got[3].message, got[3].hops, got[4].battery, got[4].hops) == ("hi", 0.0, None, None)
    assert packets.events(spark.createDataFrame(rows, "id int, packet string").limit(0)).where("kind = 'data'").count() == 0


def test_last_at_equals_search(spark):
    rng = np.random.default_rng(4)
    index = [(int(k), int(t), int(v)) for k, t, v in rng.integers(0, 40, (300, 3))] + [(1, None, 5)]
    probes = [(i, int(k), int(t)) for i, (k, t) in enumerate(rng.integers(-2, 45, (400, 2)))]
    got = {r.i: (r.at, r.value) for r in T.last_at(spark.createDataFrame(index, "k int, t int, v int"), spark.createDataFrame(probes, "i int, k int, t int"), "k", "t", "v", "i").collect()}
    for i, k, t in probes:
        best = max(((a, v) for j, a, v in index if j == k and a is not None and a <= t), default=(None, None))
        assert got[i] == best
    assert len(got) == len(probes)


def test_clearance_equals_the_loop(spark):
    rng = np.random.default_rng(7)
    houses = []
    for i in range(25):
        x, y, w, h, a = *rng.uniform(0, 150, 2), *rng.uniform(4, 14, 2), rng.uniform(0, math.pi)
        ring = [(float(x + u * math.cos(a) - v * math.sin(a)), float(y + u * math.sin(a) + v * math.cos(a))) for u, v in ((-w, -h), (w, -h), (w, h), (-w, h), (-w, -h))]
        houses.append((i, ring, float(rng.uniform(0, 2))))
    trees = [(i, *map(float, rng.uniform(-10, 160, 2)), float(rng.uniform(0.2, 3))) for i in range(400)] + [(900, 500.0, 500.0, None)]
    df = spark.createDataFrame(trees, "id int, x double, y double, radius double")
    built = spark.createDataFrame(houses, "building_id int, ring array<struct<x double, y double>>, margin double")
    for crowns, reach in ((True, 40.0), (False, 12.0)):
        want = {i: stems._cleared([(r, m) for _, r, m in houses], x, y, w or 0.0, crowns) for i, x, y, w in trees}
        got = {r.id: r for r in stems.clear_of_buildings(df, built, crowns, reach).collect()}
        assert set(got) == {i for i, p in want.items() if p is not None} and len(got) < len(trees)
        for i, r in got.items():
            assert (r.x, r.y) == pytest.approx(want[i], abs=0.0011)
            x, y = trees[i][1:3] if i < 900 else (500.0, 500.0)
            assert r.moved == (math.hypot(want[i][0] - x, want[i][1] - y) > 0)
    assert any(r.moved for r in got.values()) and stems.clear_of_buildings(df.limit(0), built).count() == 0
    assert stems.clear_of_buildings(df, built.limit(0)).where("moved").count() == 0


def test_table_functions_refuse_bad_arguments(spark):
    people = spark.createDataFrame([("a", "part", 0.0, 0.0), ("b", "part", 3.0, 4.0), ("c", "supplier", 900.0, 0.0)], "entity_id string, kind string, x double, y double")
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), F.when(F.col("id") % 10 == 5, 50.0).otherwise(1.0).alias("v"))
    assert tools.register(spark, people, cells, Grid(0.0, 10.0, 1.0, 10, 10)) == ["find_entities", "region_summary", "get_entity", "can_see"]
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    assert rows("select * from find_entities('part', 0, 0, 5)") == [("a", 0.0), ("b", 5.0)]
    assert rows("select s.n from region_summary(0, 0, 1000) s order by kind") == [(1,), (2,)]
    assert rows("select * from get_entity('c')") == [("c", "supplier", 900.0, 0.0)]
    assert [r[0] for r in rows("select visible from can_see(0.5, 9.5, 4.5, 9.5) union all select visible from can_see(0.5, 9.5, 9.5, 9.5)")] == [False, True]
    for q in ("region_summary(0, 0, -1)", "find_entities('tree', 0, 0, 5)"):
        with pytest.raises(Exception, match='"error"'):
            spark.sql(f"select * from {q}").collect()


def test_copies_of_stems_and_buildings_are_pushed_as_in_the_loop(spark, monkeypatch):
    rng = np.random.default_rng(11)
    square = lambda x, y: [(x - 6, y - 6), (x + 6, y - 6), (x + 6, y + 6), (x - 6, y + 6), (x - 6, y - 6)]
    spots = [(float(x), float(y)) for x, y in rng.integers(0, 60, (7, 2))]
    houses = [(i, square(*spots[k]), 1.0) for i, k in enumerate(rng.integers(0, 7, 60))]
    stand = [(float(x), float(y), float(r)) for x, y, r in rng.integers(1, 60, (20, 3)) / (1, 1, 20)]
    trees = [(i, *stand[k]) for i, k in enumerate(rng.integers(0, 20, 150))]
    df = spark.createDataFrame(trees, "id int, x double, y double, radius double")
    built = spark.createDataFrame(houses, "building_id int, ring array<struct<x double, y double>>, margin double")
    want = {i: stems._cleared([(r, m) for _, r, m in houses], x, y, w, True) for i, x, y, w in trees}
    got = {r.id: (r.x, r.y) for r in stems.clear_of_buildings(df, built, reach=200.0).collect()}
    assert set(got) == {i for i, p in want.items() if p} and all(got[i] == pytest.approx(want[i], abs=0.0011) for i in got)
    # a loop over copies one by one asks for far more distances than there are outlines
    asked = []
    hypot = math.hypot
    monkeypatch.setattr(stems.math, "hypot", lambda *a: asked.append(1) or hypot(*a))
    stems._pushed([(square(0.0, 0.0), 1.0, list(range(1000)))], 30.0, 0.0, 1.0, True)
    assert len(asked) == 4
