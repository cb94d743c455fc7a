"""The coupled runoff event against a loop over cells, with chunks so small that rivers cross many of them."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.operators import raster, runoff
from landloom.operators.filters import QueryError

H, W, SIZE = 26, 22, 10.0
NEAR = raster.NEIGHBOURS


def ground():
    rng = np.random.default_rng(12)
    y, x = np.mgrid[0:H, 0:W]
    z = 100 + 0.8 * x + 0.5 * np.abs(y - H / 2) + rng.normal(0, 0.25, (H, W))
    z[5:11, 8:13] -= 9.0  # a hollow, and a smaller one that spills into it
    z[15:19, 13:18] -= 6.0
    return np.round(z, 3)


def drained(z):
    """c -> (to, pond, leaves, room) by a heap flood with a rise, steepest descent and a flood fill."""
    fill = np.full(z.shape, np.inf)
    heap = []
    for r in range(H):
        for c in range(W):
            if r in (0, H - 1) or c in (0, W - 1):
                fill[r, c] = z[r, c]
                heapq.heappush(heap, (fill[r, c], r, c))
    while heap:
        v, r, c = heapq.heappop(heap)
        for dr, dc in NEAR:
            i, j = r + dr, c + dc
            if 0 <= i < H and 0 <= j < W and max(z[i, j], v + runoff.RISE) < fill[i, j] - 1e-12 and v <= fill[r, c]:
                fill[i, j] = max(z[i, j], v + runoff.RISE)
                heapq.heappush(heap, (fill[i, j], i, j))
    to, pond = {}, {}
    for r in range(H):
        for c in range(W):
            best = (0.0, None)
            for dr, dc in NEAR:
                i, j = r + dr, c + dc
                if 0 <= i < H and 0 <= j < W and (fill[r, c] - fill[i, j]) / (SIZE * math.hypot(dr, dc)) > best[0]:
                    best = (fill[r, c] - fill[i, j]) / (SIZE * math.hypot(dr, dc)), i * W + j
            to[r * W + c] = best[1]
    deep = {r * W + c for r in range(H) for c in range(W) if fill[r, c] - z[r, c] > runoff.POND}
    for c in sorted(deep):
        if c in pond:
            continue
        stack = [c]
        while stack:
            a = stack.pop()
            if a not in pond:
                pond[a] = c
                stack += [(a // W + dr) * W + a % W + dc for dr, dc in NEAR if (a // W + dr) * W + a % W + dc in deep and 0 <= a % W + dc < W]
    leaves = {c for c in pond if to[c] is None or pond.get(to[c]) != pond[c]}
    for p in set(pond.values()):
        mine = [c for c in leaves if pond[c] == p]
        first = min(mine, key=lambda c: (fill[divmod(to[c] if to[c] is not None else c, W)], c))
        spill = to[first]
        for c in mine:
            to[c] = spill
    return to, pond, leaves, fill - z


def level(cells, z, room, volume):
    lo, hi = min(z[c] for c in cells), max(z[c] + room[c] for c in cells)
    for _ in range(80):
        mid = (lo + hi) / 2
        held = sum(min(max(mid - z[c], 0), room[c]) for c in cells) * SIZE * SIZE
        lo, hi = (mid, hi) if held < volume else (lo, mid)
    return {c: min(max(hi - z[c], 0), room[c]) for c in cells}


def looped(z, state, hours, steps):
    to, pond, leaves, room = drained(z)
    z, room = z.ravel(), room.ravel()
    area, dt, n = SIZE * SIZE, hours / steps, H * W
    s = {c: dict(state[c], below=math.inf if state[c]["below_mm"] is None else state[c]["below_mm"], took=0.0, held=0.0, out=0.0) for c in range(n)}
    waits = [0] * n
    for c in to:
        if to[c] is not None:
            waits[to[c]] += 1
    order, ready = [], sorted(c for c in range(n) if not waits[c])
    while ready:
        c = ready.pop()
        order.append(c)
        if to[c] is not None:
            waits[to[c]] -= 1
            if not waits[to[c]]:
                ready.append(to[c])
    assert len(order) == n
    members = {p: [c for c in pond if pond[c] == p] for p in set(pond.values())}
    full, stored = {p: sum(room[c] for c in m) * area for p, m in members.items()}, dict.fromkeys(members, 0.0)
    infil, local_out, runon, left = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)

    def drain(h):
        for v in s.values():
            pores = v["theta_s"] - v["theta_r"]
            e = min(max((v["theta"] - v["theta_r"]) / pores, 0), 1)
            k, m = min(v["ksat"], v["lower_ksat"]), 3 + 2 / v["pore_index"]
            if k > 0 and e > 0:
                after = (e ** (1 - m) + (m - 1) * k / (v["depth_mm"] * pores) * h) ** (-1 / (m - 1))
                x = min(max(v["theta"] - v["theta_fc"], 0) * v["depth_mm"], v["held"], v["below"], (e - after) * pores * v["depth_mm"])
                v["theta"] -= x / v["depth_mm"]
                v["held"], v["below"], v["out"] = v["held"] - x, v["below"] - x, v["out"] + x

    def take(v, mm):
        v["theta"] += mm / v["depth_mm"]
        v["held"] += mm
        v["took"] += mm

    for step in range(steps):
        if step:
            drain(dt / 2)
        most, free = {}, {}
        for c, v in s.items():
            deficit = max(v["theta_limit"] - v["theta"], 0)
            a, goal = v["suction"] * deficit, v["ksat"] * dt
            lo, hi = goal, goal + a + 2 * math.sqrt(a * goal) + 1e-12
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if mid - a * math.log1p(mid / max(v["took"] + a, 1e-12)) >= goal else (mid, hi)
            most[c], free[c] = (hi if v["ksat"] > 0 else 0.0), deficit * v["depth_mm"]
        for p, m in members.items():
            if stored[p] > 0:
                for c, deep in level(m, z, room, stored[p]).items():
                    x = min(deep * 1000, most[c], free[c])
                    take(s[c], x)
                    most[c], free[c] = most[c] - x, free[c] - x
                    infil[c] += x
                    stored[p] = max(0.0, stored[p] - x / 1000 * area)
        routed = np.zeros(n)
        for c in order:
            local = s[c]["p_mm"] / 1000 * area / steps
            there = local + routed[c]
            runon[c] += routed[c]
            x = min(there / area * 1000, most[c], free[c])
            take(s[c], x)
            infil[c] += x
            out = max(0.0, there - x / 1000 * area)
            local_out[c] += local * (1 - x / 1000 * area / there) if there else 0.0
            if c in leaves:
                kept = min(out, max(0.0, full[pond[c]] - stored[pond[c]]))
                stored[pond[c]] += kept
                out -= kept
            if to[c] is None:
                left[c] += out
            else:
                routed[to[c]] += out
        drain(dt / 2)
    return infil, local_out / area * 1000, runon, left, np.array([s[c]["held"] for c in range(n)]), np.array([s[c]["out"] for c in range(n)]), stored


@pytest.fixture(scope="module")
def cells(spark):
    z = ground()
    rng = np.random.default_rng(5)
    some = lambda v: float(v) if rng.random() > 0.3 else None
    rows = [
        (r, c, float(z[r, c]), some(rng.integers(0, 60)), 30.0, 20.0, some(rng.integers(30, 200)), some(rng.integers(20, 200)), some(rng.uniform(0, 20)), some(9.0), ["A", "D", None][(r + c) % 3], some(rng.integers(30, 200)) if r % 3 else None, some(rng.integers(40, 300)) if c % 4 == 0 else None, some(rng.integers(0, 40)), float(rng.uniform(20, 90)))
        for r in range(H) for c in range(W)
    ]
    return spark.createDataFrame(rows, "row long, col long, v double, sand double, silt double, clay double, restrictive_cm double, taw_mm double, ksat_min double, surface_ksat double, hsg string, bedrock_cm double, water_table_cm double, twi double, p_mm double")


@pytest.fixture(scope="module")
def graph(cells):
    return runoff.drainage(cells.select("row", "col", "v"), SIZE, W, chunk=25)


def test_drainage_equals_flood(graph):
    to, pond, leaves, room = drained(ground())
    rows = graph.collect()
    assert len(rows) == H * W and len(pond) > 20 and len(set(pond.values())) >= 2
    for r in rows:
        assert (r.to, r.pond, r.leaves) == (to[r.c], pond.get(r.c), r.c in leaves)
        assert r.room == pytest.approx(room[r.row, r.col] if r.c in pond else 0.0, abs=1e-9)
    home = {r.c: (r.chunk, r.depth) for r in rows}
    assert max(d for _, d in home.values()) >= 2 and len({h for h, _ in home.values()}) > 4
    for r in rows:  # a way leads to the chunk below or stays; a depression is one chunk
        if r.to is not None:
            assert home[r.to] == home[r.c] or home[r.to][1] == home[r.c][1] - 1
        if r.pond is not None:
            assert home[r.c] == home[r.pond]


@pytest.mark.parametrize(("hours", "frozen"), [(5.0, False), (9.0, True)])
def test_event_equals_loop(cells, graph, hours, frozen):
    state = runoff.hydraulic_state(cells, "wet", frozen=frozen).join(cells.select("row", "col", "p_mm"), ["row", "col"])
    by_cell = {r.row * W + r.col: r.asDict() for r in state.collect()}
    found = {r.row * W + r.col: r for r in runoff.coupled_event(graph, state, hours, SIZE * SIZE).collect()}
    assert len(found) == H * W
    infil, local_out, runon, left, held, out, stored = looped(ground(), by_cell, hours, runoff.step_count(hours))
    for c in range(H * W):
        r = found[c]
        for got, want in ((r.infiltration_mm, infil[c]), (r.local_runoff_mm, local_out[c]), (r.runon_m3, runon[c]), (r.outflow_m3, left[c]), (r.root_zone_storage_mm, held[c]), (r.deep_drainage_mm, out[c])):
            assert got == pytest.approx(want, rel=1e-6, abs=1e-6)
    assert sum(r.pond_m3 for r in found.values()) == pytest.approx(sum(stored.values()), rel=1e-6) and sum(stored.values()) > 0
    one = runoff.summary(runoff.coupled_event(graph, state, hours, SIZE * SIZE), hours, 2.0, SIZE * SIZE).first()
    assert one.input_m3 == pytest.approx(one.surface_m3 + one.root_zone_storage_m3 + one.deep_drainage_m3, rel=1e-8)


def test_scenarios():
    assert runoff.forcing("rain", rain_in=2.0, storm_hours=3)["peaking"] == 3.5
    assert runoff.forcing("rain", storm_hours=900)["hours"] == 240 and runoff.forcing("snowmelt", melt_days=90)["hours"] == 720
    assert runoff.forcing("snowmelt", known={"median_in": 10.0, "p90_in": 20.0}, preset="p90", rain_in=0.5)["p_mm"] == pytest.approx(20.5 * 25.4)
    assert (runoff.step_count(1), runoff.step_count(12), runoff.step_count(96)) == (6, 12, 96)
    with pytest.raises(QueryError):
        runoff.forcing("hail")


def test_no_rain_and_unknown_states(cells, graph):
    state = runoff.hydraulic_state(cells, wetness=0.4).withColumn("p_mm", F.lit(None).cast("double"))
    event = runoff.coupled_event(graph, state, 2.0, SIZE * SIZE)
    assert event.agg(F.sum("input_m3"), F.sum("flow_m3")).first()[:] == (0.0, 0.0)
    with pytest.raises(QueryError):
        runoff.hydraulic_state(cells, "damp")


def test_a_budget_that_does_not_close_raises(cells, graph, monkeypatch):
    state = runoff.hydraulic_state(cells).withColumn("p_mm", F.lit(50.0))
    exact = runoff._event

    def leaky(*how):
        run = exact(*how)
        return lambda key, c, i: run(key, c, i).assign(outflow_m3=0.0)

    monkeypatch.setattr(runoff, "_event", leaky)
    with pytest.raises(ArithmeticError, match="does not close"):
        runoff.coupled_event(graph, state, 2.0, SIZE * SIZE)
