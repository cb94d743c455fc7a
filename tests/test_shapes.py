"""Constructed geometry against grids of sample points and plain loops."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.operators import raster, shapes

RING = "array<struct<x double, y double>>"


def inside(points, ring):
    """Even-odd over a closed ring, for an array of points."""
    x, y = points.T
    odd = np.zeros(len(points), bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (bx - ax) * (y - ay) / (by - ay) + ax
        odd ^= ((by > y) != (ay > y)) & (x < at)
    return odd


def gathered(corners):
    """group -> rings as closed lists, from the long form; every ring is numbered without a gap."""
    found = collections.defaultdict(dict)
    for r in corners.collect():
        assert r.seq not in found[r.group, r.ring]
        found[r.group, r.ring][r.seq] = (r.x, r.y)
    out = collections.defaultdict(list)
    for (g, _), ring in found.items():
        assert sorted(ring) == list(range(len(ring)))
        out[g].append([ring[i] for i in [*range(len(ring)), 0]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(g, p, [tuple(map(float, c)) for c in ring]) for g, p, ring in rows], f"group string, part long, ring {RING}")


def star(rng, cx, cy, n):
    a = np.sort(rng.uniform(0, 2 * math.pi, n))
    r = rng.uniform(15, 60, n)
    ring = [(cx + q * math.cos(t), cy + q * math.sin(t)) for t, q in zip(a, r, strict=True)]
    return [*ring, ring[0]]


def test_overlays_equal_sample_points(spark):
    rng = np.random.default_rng(8)
    rows = [(f"g{g}", p, star(rng, *rng.uniform(-40, 40, 2), 9)[:: rng.choice([-1, 1])]) for g in range(6) for p in range(2 if g < 3 else 5)]
    points = rng.uniform(-110, 110, (40_000, 2))
    for how, keep in (("union", np.any), ("intersection", np.all)):
        found = gathered(shapes.overlay(frame(spark, rows), how, size=25.0))
        for g in {r[0] for r in rows}:
            want = keep([inside(points, ring) for h, _, ring in rows if h == g], axis=0)
            got = np.zeros(len(points), int)
            for ring in found[g]:
                got += inside(points, ring)
            assert (got % 2 == 1).tolist() == want.tolist()


def test_overlays_of_shapes_that_touch(spark):
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    rows = [
        *[("equal", p, box(0, 0, 10, 10)) for p in (3, 5, 7)], ("beside", 0, box(0, 0, 10, 10)), ("beside", 1, box(10, 0, 20, 10)), ("corner", 0, box(0, 0, 10, 10)), ("corner", 1, box(10, 10, 20, 20)),
        ("inner", 0, box(0, 0, 30, 30)), ("inner", 1, box(10, 10, 20, 20)), ("apart", 0, box(0, 0, 1, 1)), ("apart", 1, box(5, 5, 6, 6)), ("part", 0, box(0, 0, 10, 10)), ("part", 1, box(0, 4, 10, 6)),
        ("frame", 0, box(0, 0, 30, 10)), ("frame", 1, box(0, 20, 30, 30)), ("frame", 2, box(0, 0, 10, 30)), ("frame", 3, box(20, 0, 30, 30)), ("flat", 0, [(0, 0), (5, 0), (0, 0)]), ("flat", 1, box(0, 0, 2, 2)),
    ]
    area = lambda how: {g: sorted(round(r.area, 6) for r in rs) for g, rs in _by(shapes.ring_areas(shapes.overlay(frame(spark, rows), how)).collect()).items()}
    assert area("union") == {"equal": [100], "beside": [200], "corner": [100, 100], "inner": [900], "apart": [1, 1], "part": [100], "frame": [-100, 900], "flat": [4]}
    assert area("intersection") == {"equal": [100], "inner": [100], "part": [20], "flat": [4]}
    assert shapes.overlay(frame(spark, rows).limit(0), "union").count() == 0
    with pytest.raises(ValueError):
        shapes.overlay(frame(spark, rows), "minus")


def _by(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.group].append(r)
    return out


def test_buffer_equals_distance_on_a_grid(spark):
    paths = {1: [(0, 0), (100, 0), (100, 80)], 2: [(5, 5)], 3: [(0, 0), (60, 0), (60, 60), (0, 60), (0, 5)], 4: [(0, 0), (30, 40), (0, 0)]}
    df = spark.createDataFrame([(k, [tuple(map(float, p)) for p in v]) for k, v in paths.items()], f"k int, path {RING}")
    found = gathered(shapes.buffer(df, "k", 12.0, quarter=16))
    points = np.random.default_rng(1).uniform(-20, 130, (20_000, 2))
    for k, path in paths.items():
        near = np.full(len(points), np.inf)
        for (ax, ay), (bx, by) in zip(path, path[1:] or path, strict=False):
            d = np.array([bx - ax, by - ay], float)
            t = np.clip(((points - (ax, ay)) @ d) / max(d @ d, 1e-12), 0, 1)
            near = np.minimum(near, np.hypot(*(points - (ax, ay) - t[:, None] * d).T))
        got = np.sum([inside(points, r) for r in found[k]], axis=0) % 2 == 1
        assert not (got & (near > 12.0 + 1e-6)).any()
        assert got[near < 12.0 * math.cos(math.pi / 32) ** 2 - 1e-6].all()
    assert len(found[3]) == 2  # the ring has a hole


def test_polygonise_gives_cells_back(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 3, (14, 17))
    v[3:9, 4:12], v[5:7, 6:9] = 7, 8  # a region with a hole
    grid = raster.Grid(0.0, 14.0, 1.0, 17, 14)
    cells = spark.createDataFrame([(r, c, int(v[r, c]) if (r, c) != (0, 0) else None) for r in range(14) for c in range(17)], "row long, col long, v int")
    found = gathered(shapes.polygonise(cells, grid))
    centres = np.array([(c + 0.5, 13.5 - r) for r in range(14) for c in range(17)])
    flat = v.ravel().copy()
    flat[0] = -1
    for k in set(flat.tolist()) - {-1}:
        got = np.sum([inside(centres, ring) for ring in found[k]], axis=0) % 2 == 1
        assert (got == (flat == k)).all()
    areas = [(r.group, r.area) for r in shapes.ring_areas(shapes.polygonise(cells, grid)).collect()]
    assert {k: sum(a for g, a in areas if g == k) for k, _ in areas} == {k: (flat == k).sum() for k in set(flat.tolist()) - {-1}}
    assert any(a < 0 for g, a in areas if g == 7) and -1 not in found
    long = spark.range(700).select(F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), F.lit(1).alias("v"))
    assert shapes.ring_areas(shapes.polygonise(long, grid)).first()[2:] == (700.0, 1402)
    assert shapes.polygonise(cells.limit(0), grid).count() == 0


def test_hulls_and_rectangles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    sets = {"cloud": rng.normal(0, 30, (400, 2)), "line": np.array([(i, 2.0 * i) for i in range(20)]), "one": np.array([(3.0, 4.0)] * 5), "grid": np.array([(i % 9, i // 9) for i in range(81)], float), "two": np.array([(0.0, 0.0), (3.0, 4.0)])}
    turn = math.radians(30)
    box = np.stack([rng.uniform(-40, 40, 500), rng.uniform(-10, 10, 500)], 1)
    box = np.concatenate([box, [(-40, -10), (40, -10), (40, 10), (-40, 10)]])
    sets["turned"] = box @ np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
    rows = [(g, float(x), float(y)) for g, p in sets.items() for x, y in p] + [("one", None, 1.0), (None, 1.0, 1.0)]
    got = {r.group: r for r in shapes.footprints(spark.createDataFrame(rows, "g string, x double, y double").repartition(7), "g").collect()}
    assert (got["grid"].corners, got["grid"].area, got["line"].corners, got["line"].area, got["one"].corners, got["two"].long, got[None].corners) == (4, 64.0, 2, 0.0, 1, 5.0, 1)
    assert (got["turned"].long, got["turned"].short, got["turned"].angle) == (pytest.approx(80), pytest.approx(20), pytest.approx(30))
    for g, p in sets.items():  # no direction of a fine fan gives a smaller rectangle
        fan = [(np.ptp(p @ (math.cos(t), math.sin(t))), np.ptp(p @ (-math.sin(t), math.cos(t)))) for t in np.linspace(0, math.pi / 2, 2000)]
        assert got[g].long * got[g].short <= min(a * b for a, b in fan) + 1e-9
    h = shapes.hull(sets["cloud"])
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    assert all(cross(a, b, c) >= -1e-9 for a, b in zip(h, np.roll(h, -1, 0), strict=True) for c in sets["cloud"])
    assert got["cloud"].corners == len(h)


def test_distance_field_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(r, c, bool(rng.random() < 0.04)) for r in range(30) for c in range(25) if rng.random() < 0.9]
    cells = spark.createDataFrame(rows, "row long, col long, s boolean")
    seeds = np.array([(r, c) for r, c, s in rows if s])
    for x in shapes.distance_field(cells, F.col("s"), 5.0).collect():
        assert x.distance == pytest.approx(5 * np.sqrt(((seeds - (x.row, x.col)) ** 2).sum(1).min()))
    assert shapes.distance_field(cells, F.col("s"), 5.0).count() == len(rows)
    assert {x.distance for x in shapes.distance_field(cells, F.lit(None).cast("boolean"), 5.0).collect()} == {None}
    assert shapes.distance_field(cells.limit(0), F.col("s"), 5.0).count() == 0


def test_no_frame_of_the_distance_field_runs_to_the_end(spark):
    """A frame up to the end of a column is read anew for each of its rows."""
    cells = spark.range(3000).selectExpr("id as row", "id % 2 as col", "id % 1000 = 7 as s")
    found = shapes.distance_field(cells, F.col("s"), 5.0)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(x.row, x.distance) for x in found.where("row in (2, 7, 506, 508, 2999)").collect()} == {(2, 5 * 26**0.5), (7, 0.0), (506, 5 * (499**2 + 1) ** 0.5), (508, 5 * (499**2 + 1) ** 0.5), (2999, 5 * 992.0)}


def test_rings_over_many_tiles_equal_those_of_one(spark, monkeypatch):
    rng = np.random.default_rng(12)
    cells = spark.createDataFrame([(r, c, int(v)) for (r, c), v in np.ndenumerate(rng.integers(0, 2, (24, 9)))], "row long, col long, v int")
    grid = raster.Grid(0.0, 24.0, 1.0, 9, 24)

    def turned(found):
        """Every ring begun at its smallest corner that is met once, for comparison."""
        return {g: sorted(min(ring[k:-1] + ring[:k] for k in range(len(ring) - 1)) for ring in rings) for g, rings in found.items()}

    whole = turned(gathered(shapes.polygonise(cells, grid)))
    monkeypatch.setattr(shapes, "TILE", 6)
    assert turned(gathered(shapes.polygonise(cells, grid))) == whole


def test_overlays_take_copies_as_one(spark):
    square = lambda x, y: [(x, y), (x + 120, y), (x + 120, y + 120), (x, y + 120), (x, y)]
    parts = frame(spark, [("a", k, square(k % 3 * 50, 0)) for k in range(40)])
    for how, area in (("union", 220.0 * 120), ("intersection", 20.0 * 120)):
        assert [r.area for r in shapes.ring_areas(shapes.overlay(parts, how)).collect()] == [pytest.approx(area)]


def test_parts_meet_only_in_cells_that_several_hold(spark, monkeypatch):
    """Strips 20 km long that cross once, and a square in the middle of another: edges are kept only where parts meet, and no part is held against every cell under its box."""
    tables = []
    monkeypatch.setattr(shapes, "checkpointed", lambda df, real=shapes.checkpointed: tables.append(real(df)) or tables[-1])
    monkeypatch.setattr(shapes.geo, "path_distance", None)
    strip = lambda ax, ay, bx, by: [(ax - 10, ay), (ax + 10, ay), (bx + 10, by), (bx - 10, by), (ax - 10, ay)]
    box = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
    rows = [("cross", 0, strip(0, 0, 20_000, 20_000)), ("cross", 1, strip(20_000, 0, 0, 20_000)), ("within", 0, box(3050, 3050, 3000)), ("within", 1, box(3050, 3050, 10)), ("within", 2, box(3050, 9000, 10))]
    found = {g: sorted(round(r.area, 6) for r in rs) for g, rs in _by(shapes.ring_areas(shapes.overlay(frame(spark, rows), "union")).collect()).items()}
    assert found == {"cross": [2 * 20 * 20_000 - 200], "within": [400, 36_000_000]}
    near = [t.count() for t in tables if {"x1", "cx"} <= set(t.columns)]
    assert near and max(near) < 60  # the strips alone touch more than 1,000 cells
    held = [t for t in tables if t.columns == ["group", "part", "cx", "cy"]]
    assert sorted({(r["group"], r["part"]) for t in held for r in t.collect()}) == [("cross", 0), ("cross", 1), ("within", 0), ("within", 1)]


def test_groups_of_few_edges_are_chained_in_one_task(spark, monkeypatch):
    """Rings of small groups do not end at the borders of tiles, however far they reach."""
    monkeypatch.setattr(shapes, "TILE", 6)
    monkeypatch.setattr(shapes, "roots", None)
    rows = [(f"g{k}", [(0, 0), (1000 + k, 0), (1000 + k, 500), (0, 500), (0, 0)]) for k in range(9)]
    edges = [(g, *map(float, a), *map(float, b)) for g, ring in rows for a, b in zip(ring, ring[1:], strict=False)]
    found = gathered(shapes.rings(spark.createDataFrame(edges, "group string, x1 double, y1 double, x2 double, y2 double").repartition(5)))
    assert {g: [sorted(ring[:-1]) for ring in rings] for g, rings in found.items()} == {g: [sorted(map(tuple, ring[:-1]))] for g, ring in rows}


def test_touched_cells_are_those_near_the_segment(spark):
    from landloom.operators import spatial

    rng = np.random.default_rng(4)
    segments = [*rng.uniform(-90, 90, (40, 4)).tolist(), [0, 5, 60, 5], [7, -30, 7, 40], [3, 3, 3, 3], [-10, -10, 20, 20], [0, 0, 50, 1e-9]]
    df = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(segments)], "k int, x1 double, y1 double, x2 double, y2 double")
    for r in (0.0, 13.0):
        got = {(x.k, x.cx, x.cy) for x in spatial.touched(df, 10.0, r).collect()}
        want = set()
        for k, (ax, ay, bx, by) in enumerate(segments):
            lo, hi = (np.floor((f([ax, bx]) + s * r) / 10) for f, s in ((min, -1), (max, 1)))
            low, high = (np.floor((f([ay, by]) + s * r) / 10) for f, s in ((min, -1), (max, 1)))
            d = np.array([bx - ax, by - ay])
            for cx in range(int(lo), int(hi) + 1):
                for cy in range(int(low), int(high) + 1):
                    p = np.array([cx * 10 + 5 - ax, cy * 10 + 5 - ay])
                    t = np.clip(p @ d / (d @ d), 0, 1) if d @ d else 0.0
                    if np.hypot(*(p - t * d)) <= r + 7.072:
                        want.add((k, cx, cy))
        assert got == want
