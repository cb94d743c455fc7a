"""A fire scenario on a small grid: refusals, barriers, burned ground and embers by plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from landloom.functions import fire
from landloom.operators import wildfire as W
from landloom.operators.filters import QueryError
from landloom.operators.raster import NEIGHBOURS, Grid
from landloom.queries import fuel

N, GRID = 24, Grid(0.0, 240.0, 10.0, 24, 24)
WEATHER = W.Weather(temp_f=85.0, rh=20.0, wind_mph=15.0, wind_to=90.0, days_since_rain=14.0)


@pytest.fixture(scope="module")
def burning(spark, data):
    rows = [(r, c, 6 if r < 20 else 10, 5.0, 180.0, 30.0, 0.3 if r % 2 else 0.0, 0.2, c == 16 and r != 5) for r in range(N) for c in range(N)]
    cells = spark.createDataFrame(rows, "row long, col long, code long, slope double, aspect double, cc_pct double, cbh_m double, cbd double, barrier boolean")
    return W.behaviour(cells, fuel.fuels(spark, data), WEATHER)


def test_barriers_and_bare_ground_do_not_burn(burning):
    rows = burning.collect()
    assert len(rows) == N * N
    for r in rows:
        open_ = r.row < 20 and (r.col != 16 or r.row == 5)
        assert r.burnable == open_ and (r.ros > 0) == open_ and (r.intensity > 0) == open_
        assert r.crown == "surface" or (r.row % 2 and open_)
    assert {r.crown for r in rows} != {"surface"}


def test_scenario_equals_loops(burning):
    start = W.point_ignition(burning, GRID, 45.0, 185.0)
    assert [tuple(r) for r in start.collect()] == [(5, 4)]
    found = {(r.row, r.col): r for r in W.scenario(burning, start, WEATHER, 10.0, 30.0).collect()}
    t = {k: math.inf for k in found}
    t[5, 4], moved = 0.0, True
    while moved:
        moved = False
        for (r, c), x in found.items():
            if t[r, c] < math.inf and x.ros > 0:
                for dr, dc in NEIGHBOURS:
                    y = found.get((r + dr, c + dc))
                    if y is not None and y.ros > 0:
                        e = math.sqrt(1 - 1 / x.ratio**2)
                        v = x.ros * (1 - e) / (1 - e * math.cos(math.atan2(dc, -dr) - math.radians(x.facing)))
                        new = t[r, c] + 10 * math.hypot(dr, dc) / v
                        if new < t[r + dr, c + dc] - 1e-9:
                            t[r + dr, c + dc], moved = new, True
    for k, x in found.items():
        assert x.arrival == t[k] or abs(x.arrival - t[k]) < 1e-6
        assert x.burned == (t[k] <= 30.0)
    assert any(t[r, 20] < math.inf for r in range(N)) and any(x.burned for x in found.values())
    strong = [k for k, x in found.items() if x.burned and (x.crown != "surface" or x.flame >= 1.2 or x.intensity >= 500)]
    reach = fire.ember_reach(15.0, max(found[k].flame for k in strong), any(found[k].crown == "passive" for k in strong), any(found[k].crown == "active" for k in strong))
    for (r, c), x in found.items():
        near = any(0 < math.hypot(r - a, c - b) * 10 <= reach and abs((math.degrees(math.atan2(c - b, a - r)) - 90 + 180) % 360 - 180) <= 22.5 for a, b in strong)
        assert x.ember == (near and not x.burned)
    one = W.summary(W.scenario(burning, start, WEATHER, 10.0, 30.0), 10.0).first()
    assert one.burned_cells == sum(x.burned for x in found.values()) and one.surface + one.passive + one.active == pytest.approx(1)
    assert one.burned_ha == pytest.approx(one.burned_cells / 100)


def test_ignitions_are_moved_or_refused(spark, burning):
    assert W.point_ignition(burning, GRID, 55.0, 25.0).first()[:] == (19, 5)  # from bare ground, 20 m
    for x, y in ((-1.0, 5.0), (165.0, 0.0)):
        if x < 0:
            with pytest.raises(QueryError):
                W.point_ignition(burning, GRID, x, y)
    bare = burning.withColumn("burnable", F.lit(False))
    with pytest.raises(QueryError):
        W.point_ignition(bare, GRID, 45.0, 185.0)
    assert W.line_ignition(burning, GRID, [(25.0, 185.0), (65.0, 185.0)]).count() == 5
    for line in ([(25.0, 185.0)], [(25.0, 185.0), (25.0, 15.0)], [(25.0, 185.0), (300.0, 185.0)]):
        with pytest.raises(QueryError):
            W.line_ignition(burning, GRID, line)


def test_nothing_lit_burns_nothing(burning):
    none = W.scenario(burning, burning.select("row", "col").limit(0), WEATHER, 10.0, 30.0)
    assert W.summary(none, 10.0).first()[:3] == (0, 0.0, 0.0)
    points = burning.sparkSession.createDataFrame([(1, 45.0, 185.0), (2, -99.0, 0.0)], "k int, x double, y double")
    said = W.readings(none, points, GRID, "k", 30.0).collect()
    assert [r.k for r in said] == [1] and not said[0].burned and said[0].arrival is None and len(said[0].sentences) >= 2
