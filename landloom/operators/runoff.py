"""A coupled runoff event: rain or melt on soils, run-on, ponds, drainage, with a closed water budget.

Cells drain along a forest: filled ground by steepest descent, each depression a reservoir of its own that spills through its lowest exit. A
cell's state over all time steps follows from the series of what arrives there, so the forest is cut into connected chunks of about
``CHUNK`` cells: along a river where the cells above pass a multiple of that, never through a depression. Chunks far from an outlet
run first, all of a depth at once, and hand the series of their outflow to the chunk below. Rounds are the chunks along the longest
river; a task holds one chunk, or a pack of small ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.session import checkpointed

from . import raster, soil, spread
from .filters import QueryError

#: Cells of a chunk, about; a depression is never cut.
CHUNK = 20_000
#: Rise of filled ground per cell, and the least depth of a depression, in metres.
RISE, POND = 1e-3, 1e-4

# Residual, wilting, field capacity, porosity, pore index, conductivity in mm/h, suction in mm by texture class.
TEXTURES = {
    "sand": (0.020, 0.033, 0.048, 0.437, 0.694, 222.8, 101.1),
    "loamy sand": (0.035, 0.055, 0.084, 0.437, 0.553, 60.45, 130.8),
    "sandy loam": (0.041, 0.095, 0.155, 0.453, 0.378, 23.85, 218.65),
    "loam": (0.027, 0.117, 0.200, 0.463, 0.252, 13.2, 245.0),
    "silt loam": (0.015, 0.133, 0.261, 0.501, 0.234, 6.8, 366.8),
    "sandy clay loam": (0.068, 0.148, 0.187, 0.398, 0.319, 3.65, 493.65),
    "clay loam": (0.075, 0.197, 0.245, 0.464, 0.242, 2.15, 427.45),
    "silty clay loam": (0.040, 0.208, 0.300, 0.471, 0.177, 1.75, 559.65),
    "sandy clay": (0.109, 0.239, 0.232, 0.430, 0.223, 1.2, 551.25),
    "silty clay": (0.056, 0.250, 0.317, 0.479, 0.150, 0.95, 612.35),
    "clay": (0.090, 0.272, 0.296, 0.475, 0.165, 0.6, 668.25),
}
# Conductivity in mm/h by soil group, initial fill and the wetness rank from which cells start wetter by antecedent state.
GROUPS = {"A": 10.0, "B": 5.7, "C": 2.5, "D": 0.6, "A/D": 0.6, "B/D": 0.6, "C/D": 0.6}
FILL = {"dry": 0.2, "normal": 0.5, "wet": 0.9}
WETTER = {"dry": 0.97, "normal": 0.85, "wet": 0.65}
# Root zone in cm, its water in mm where unknown, spread of the fill by rank, frozen conductivity and pores, smallest share of surface water told, inch in mm.
ROOT_CM, ROOT_MM, SPREAD, FROZEN_K, FROZEN_PORES, LEAST_SHARE, INCH = 70.0, 100.0, 0.2, 0.03, 0.1, 0.002, 25.4
MOST_MELT_DAYS, MOST_STORM_HOURS, LEAST_STEPS, MOST_STEP_HOURS = 30.0, 240.0, 6, 1.0

STATE = ["theta", "theta_limit", "theta_s", "theta_r", "theta_fc", "pore_index", "ksat", "suction", "depth_mm", "lower_ksat", "below_mm"]
SOIL = ["sand", "silt", "clay", "restrictive_cm", "taw_mm", "ksat_min", "surface_ksat", "hsg", "bedrock_cm", "water_table_cm"]
DEPTHS = ["local_runoff_mm", "infiltration_mm", "local_infiltration_mm", "root_zone_storage_mm", "deep_drainage_mm", "saturation_excess_mm", "saturation_pct", "initial_saturation_pct", "ponded_water_mm"]
VOLUMES = ["input_m3", "runon_m3", "flow_m3", "outflow_m3", "pond_m3"]


def _blend(wetness: float, by: dict[str, float]) -> float:
    return float(np.interp(min(max(wetness, 0.0), 1.0), [0.0, 0.5, 1.0], [by["dry"], by["normal"], by["wet"]]))


def hydraulic_state(cells: DataFrame, antecedent: str = "normal", wetness: float | None = None, frozen: bool = False) -> DataFrame:
    """The cells (``row, col, twi`` and the columns of SOIL, any of them null) with the soil state of STATE: water contents as
    shares, depths in mm, conductivities in mm/h; ``below_mm`` is null where drainage has no bound.

    ``wetness`` (0 to 1) takes the place of the ``antecedent`` class. Ranks of ``twi`` spread the initial fill and start the wettest cells
    nearer saturation; a cell without ``twi`` counts as middling.
    """
    if wetness is None and antecedent not in FILL:
        raise QueryError("unknown antecedent state", antecedent=antecedent, known=list(FILL))
    fill = FILL[antecedent] if wetness is None else _blend(wetness, FILL)
    since = WETTER[antecedent] if wetness is None else _blend(wetness, WETTER)
    c = F.col
    whole = c("sand") + c("silt") + c("clay")
    share = lambda n: 100.0 * c(n) / whole
    kind = soil.texture(share("sand"), share("silt"), share("clay"))
    kind = F.when(whole.isNull() | (whole <= 0), "sandy loam").when(kind == "silt", "silt loam").otherwise(kind)
    names = ["theta_r", "wilting", "_", "theta_s", "pore_index", "texture_ksat", "suction"]
    spec = "texture string, " + ", ".join(f"{n} double" for n in names)
    table = cells.sparkSession.createDataFrame([(t, *v) for t, v in TEXTURES.items()], spec).drop("_")
    ranks = raster.midrank(cells.select("row", "col", c("twi").alias("v"))).withColumnRenamed("pct", "rank")
    at = cells.withColumn("texture", kind).join(F.broadcast(table), "texture").join(ranks, ["row", "col"], "left")
    groups = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    clip = lambda v, lo, hi: F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))
    at = at.withColumn("depth_mm", F.when(c("restrictive_cm").isNotNull(), F.least(F.lit(ROOT_CM * 10), F.greatest(F.lit(50.0), c("restrictive_cm") * 10))).otherwise(ROOT_CM * 10))
    awc = clip(F.coalesce("taw_mm", F.lit(ROOT_MM)) / F.greatest("depth_mm", F.lit(1.0)), 0.02, 0.30)
    at = at.withColumn("theta_fc", F.least(c("theta_s") - 0.01, c("wilting") + awc))
    start = clip(fill + SPREAD * (F.coalesce("rank", F.lit(0.5)) - 0.5), 0.02, 0.98)
    at = at.withColumn("base", c("wilting") + start * F.greatest(F.lit(0.01), c("theta_fc") - c("wilting")))
    wetter = clip((F.coalesce("rank", F.lit(0.0)) - since) / max(1 - since, 1e-6), 0, 1)
    at = at.withColumn("theta", c("base") + wetter * (c("theta_s") - c("base")))
    known = F.coalesce(c("ksat_min"), c("surface_ksat"), F.try_element_at(groups, c("hsg")), F.lit(GROUPS["B"]))
    at = at.withColumn("ksat", F.least(F.greatest(known, F.lit(0.0)), c("texture_ksat")) * (FROZEN_K if frozen else 1.0))
    at = at.withColumn("theta_limit", c("theta") + FROZEN_PORES * (c("theta_s") - c("theta")) if frozen else c("theta_s"))
    typed = c("bedrock_cm").isNotNull() | c("water_table_cm").isNotNull()
    shallow = lambda n: F.coalesce(c(n) <= ROOT_CM, F.lit(False))
    shut = shallow("bedrock_cm") | shallow("water_table_cm") | (~typed & shallow("restrictive_cm"))
    floor = F.when(typed, F.least("bedrock_cm", "water_table_cm")).otherwise(c("restrictive_cm"))
    room = F.greatest(floor - ROOT_CM, F.lit(0.0)) * 10 * F.greatest(c("theta_s") - c("theta_fc"), F.lit(0.0))
    at = at.withColumn("lower_ksat", F.when(shut, 0.0).otherwise(c("ksat"))).withColumn("below_mm", F.when(shut, 0.0).otherwise(room))
    return at.select("row", "col", "texture", *STATE)


def drainage(cells: DataFrame, size: float, width: int, chunk: int = CHUNK) -> DataFrame:
    """The forest that the cells (``row, col, v``) drain along: ``row, col, c, to, pond, leaves, ground, room, chunk, depth``.

    ``to`` is the cell below (null at outlets), ``pond`` the number of a cell's depression, ``leaves`` tells whether a cell spills from one, ``ground`` and
    ``room`` are height and depth of standing water; ``chunk`` and its ``depth`` (chunks to the outlet) order the work.
    """
    cell = F.col("row") * width + F.col("col")
    filled = checkpointed(spread.fill_depressions(cells, RISE))
    ways = raster.flow_directions(filled.select("row", "col", F.col("filled").alias("v")), size)
    below = raster.receivers(ways).select(cell.alias("c"), (F.col("trow") * width + F.col("tcol")).alias("t"))
    deep = filled.where(F.col("filled") - F.col("v") > POND)
    ponds = raster.label_components(deep.select("row", "col"), width).select(cell.alias("c"), F.col("label").alias("pond"))
    graph = filled.select("row", "col", cell.alias("c"), "v", "filled").join(below, "c", "left").join(ponds, "c", "left")
    ahead = filled.select(cell.alias("t"), F.col("filled").alias("t_filled")).join(ponds.select(F.col("c").alias("t"), F.col("pond").alias("t_pond")), "t", "left")
    graph = graph.join(ahead, "t", "left").withColumn("leaves", F.col("pond").isNotNull() & ~F.coalesce(F.col("pond") == F.col("t_pond"), F.lit(False)))
    spills = graph.where("leaves").groupBy("pond").agg(F.min(F.struct(F.coalesce("t_filled", "filled").alias("at"), "c", "t")).alias("m")).select("pond", F.col("m.t").alias("spill"))
    graph = graph.join(spills, "pond", "left").withColumn("to", F.when(F.col("leaves"), F.col("spill")).otherwise(F.col("t")))
    graph = checkpointed(graph.select("row", "col", "c", "to", "pond", "leaves", F.col("v").alias("ground"), F.when(F.col("pond").isNotNull(), F.col("filled") - F.col("v")).otherwise(0.0).alias("room")))
    # a depression is one unit, named by a negative number; other cells are units of their own
    unit = F.when(F.col("pond").isNotNull(), -F.col("pond") - 1).otherwise(F.col("c"))
    units = graph.select("c", unit.alias("u"))
    sizes = units.groupBy("u").agg(F.count("*").alias("acc"))
    edges = graph.where("to is not null and (pond is null or leaves)").select(unit.alias("u"), F.col("to").alias("c")).join(units.withColumnRenamed("u", "p"), "c").select("u", "p").distinct()
    edges = checkpointed(edges)
    acc = raster.totals(sizes.withColumnRenamed("u", "c"), edges.select(F.col("u").alias("c"), F.col("p").alias("t")))
    part = lambda name: F.floor(F.col(name) / chunk)
    sized = edges.join(acc.select(F.col("c").alias("u"), F.col("acc").alias("mine")), "u").join(acc.select(F.col("c").alias("p"), F.col("acc").alias("theirs")), "p")
    cut = (F.col("mine") >= chunk) & (part("mine") != part("theirs"))
    sized = checkpointed(sized.select("u", "p", cut.alias("cut")))
    inside = raster.roots(sized.where("not cut").select(F.col("u").alias("c"), F.col("p").alias("t")))
    home = checkpointed(sizes.select("u").join(inside.select(F.col("c").alias("u"), "root"), "u", "left").select("u", F.coalesce("root", "u").alias("chunk")))
    between = sized.where("cut").select(F.col("u").alias("chunk"), F.col("p").alias("u")).join(home.withColumnRenamed("chunk", "under"), "u").select(F.col("chunk").alias("c"), F.col("under").alias("t"))
    depth = raster.roots(between).select(F.col("c").alias("chunk"), F.col("steps").alias("depth"))
    placed = home.join(depth, "chunk", "left").select("u", "chunk", F.coalesce("depth", F.lit(0)).alias("depth"))
    return checkpointed(graph.withColumn("u", unit).join(placed, "u").drop("u"))


class Ponds:
    """The depressions of a chunk by number, ``of`` each cell (-1: none); all that hold water are levelled at once.

    The volume below every level at which a cell begins or ends to fill is known beforehand: ramps of a pond's cells, added up.
    """

    def __init__(self, pond: np.ndarray, ground: np.ndarray, room: np.ndarray, area: float):
        inside = np.flatnonzero(pond >= 0)
        names, number, self.sizes = np.unique(pond[inside], return_inverse=True, return_counts=True)
        self.of = np.full(len(pond), -1)
        self.of[inside] = number
        self.cells = inside[np.argsort(number, kind="stable")]
        self.ground, self.room, self.area = ground[self.cells], room[self.cells], area
        owner = np.repeat(np.arange(len(names)), self.sizes)
        at = np.concatenate([self.ground, self.ground + self.room])
        by = np.lexsort((at, np.concatenate([owner, owner])))
        turn = np.repeat([1.0, -1.0], len(owner))
        self.at, self.wet = at[by], np.cumsum(turn[by])  # as many ramps end in a pond as begin
        self.ends = np.cumsum(2 * self.sizes)
        self.starts = self.ends - 2 * self.sizes
        self.below = np.zeros(len(at))
        self.below[1:] = np.diff(self.at) * self.wet[:-1]
        self.below[self.starts] = 0.0
        for lo, hi in zip(self.starts, self.ends, strict=True):
            np.cumsum(self.below[lo:hi], out=self.below[lo:hi])
        self.below *= area
        self.capacity, self.held = self.sums(self.room, self.sizes) * area, np.zeros(len(names))

    @staticmethod
    def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of consecutive runs of values, none of them empty."""
        return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)

    def depths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ponds that hold water, their cells, and how deep it stands on these: one level in each, found where its ramps add up to what it holds."""
        full = np.flatnonzero(self.held > 0)
        volume, start, end = self.held[full], self.starts[full], self.ends[full]
        lo, hi = start.copy(), end.copy()
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, end - 1)
            less = self.below[mid] < volume
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        i = np.minimum(lo, end - 1)
        before = np.maximum(i - 1, 0)
        rises = (i > start) & (self.wet[before] > 0)
        rise = np.divide(np.minimum(volume, self.below[end - 1]) - self.below[before], self.wet[before] * self.area, out=np.zeros(len(full)), where=rises)
        level = np.where(rises, self.at[before] + rise, self.at[i])
        mine = np.repeat(self.held > 0, self.sizes)
        return full, self.cells[mine], np.clip(np.repeat(level, self.sizes[full]) - self.ground[mine], 0.0, self.room[mine])

    def catch(self, cells: np.ndarray, out: np.ndarray) -> np.ndarray:
        """What goes on of the water that leaves ``cells``, each of a pond, when ponds take what they have room for; cells of a pond in their order."""
        out, left = out.copy(), np.flatnonzero(out > 0)
        while len(left):
            ponds, first = np.unique(self.of[cells[left]], return_index=True)
            j = left[first]
            kept = np.minimum(out[j], np.maximum(0.0, self.capacity[ponds] - self.held[ponds]))
            self.held[ponds] += kept
            out[j] -= kept
            left = np.delete(left, first)
        return out


class Soil:
    """State of a chunk's cells over an event, in NumPy; the names are those of STATE."""

    def __init__(self, rows: pd.DataFrame):
        for name in STATE:
            setattr(self, name, rows[name].to_numpy(float).copy())
        self.below_mm = np.where(np.isnan(self.below_mm), np.inf, self.below_mm)
        self.first = self.theta.copy()
        self.intake, self.stored, self.drained = (np.zeros(len(rows)) for _ in range(3))

    def capacity(self, hours: float) -> tuple[np.ndarray, np.ndarray]:
        """Most that may infiltrate in a step by Green and Ampt, and the room in the pores, in mm."""
        deficit = np.maximum(self.theta_limit - self.theta, 0.0)
        a, target = self.suction * deficit, self.ksat * hours
        lo, hi = target.copy(), target + a + 2 * np.sqrt(a * target) + 1e-12
        start = np.maximum(self.intake + a, 1e-12)
        for _ in range(32):
            mid = (lo + hi) / 2
            over = mid - a * np.log1p(mid / start) >= target
            lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
        return np.where(self.ksat > 0, (lo + hi) / 2, 0.0), deficit * self.depth_mm

    def take(self, mm: np.ndarray, at=slice(None)) -> None:
        self.theta[at] += mm / self.depth_mm[at]
        self.stored[at] += mm
        self.intake[at] += mm

    def drain(self, hours: float) -> None:
        """Gravity drainage of event water above field capacity, by Brooks and Corey, solved exactly."""
        pores = np.maximum(self.theta_s - self.theta_r, 1e-6)
        s = np.clip((self.theta - self.theta_r) / pores, 0.0, 1.0)
        m = 3 + 2 / np.maximum(self.pore_index, 0.05)
        k = np.minimum(self.ksat, self.lower_ksat)
        moves = (k > 0) & (s > 0)
        after = s.copy()
        rate = k / np.maximum(self.depth_mm * pores, 1e-9)
        after[moves] = (s[moves] ** (1 - m[moves]) + (m[moves] - 1) * rate[moves] * hours) ** (-1 / (m[moves] - 1))
        potential = np.maximum(0.0, (s - after) * pores * self.depth_mm)
        excess = np.maximum(self.theta - self.theta_fc, 0.0) * self.depth_mm
        out = np.minimum.reduce([excess, self.stored, self.below_mm, potential])
        self.theta -= out / self.depth_mm
        self.stored = np.maximum(0.0, self.stored - out)
        self.below_mm = np.maximum(0.0, self.below_mm - out)
        self.drained += out


def _event(hours: float, steps: int, area: float):
    def run(key, cells: pd.DataFrame, inflow: pd.DataFrame) -> pd.DataFrame:
        """The event in one chunk or pack; ``inflow`` has ``c, series`` from the chunks above."""
        cells = cells.sort_values("c").reset_index(drop=True)
        n, dt = len(cells), hours / steps
        number = pd.Series(np.arange(n), index=cells["c"])
        to = cells["to"].map(number).fillna(-1).to_numpy(np.int64)
        # cells in waves: all that drains into a wave lies in those before
        waits, waves = np.bincount(to[to >= 0], minlength=n), []
        wave = np.flatnonzero(waits == 0)
        while len(wave):
            waves.append(wave)
            under = to[wave][to[wave] >= 0]
            np.subtract.at(waits, under, 1)
            wave = np.unique(under)
            wave = wave[waits[wave] == 0]
        if sum(map(len, waves)) != n:
            raise ValueError("the drainage graph has a cycle")
        pond = cells["pond"].fillna(-1).to_numpy(np.int64)
        leaves = cells["leaves"].to_numpy(bool)
        ponds = Ponds(pond, cells["ground"].to_numpy(float), cells["room"].to_numpy(float), area)
        spilling = [np.flatnonzero(leaves[wave]) for wave in waves]
        arriving = np.zeros((steps, n))
        for c, series in zip(inflow["c"], inflow["series"], strict=True):
            arriving[:, number[c]] += series
        land = Soil(cells)
        rain = np.maximum(cells["p_mm"].fillna(0.0).to_numpy(float), 0.0) / 1000 * area / steps
        zero = lambda: np.zeros(n)
        infiltrated, local_in, local_out, saturated, runon, flow = (zero() for _ in range(6))
        sent = np.zeros((steps, n))
        for step in range(steps):
            if step:
                land.drain(dt / 2)
            most, free = land.capacity(dt)
            pooled = zero()
            full, m, deep = ponds.depths()
            if len(full):
                pooled[m] = np.minimum.reduce([deep * 1000, most[m], free[m]])
                ponds.held[full] = np.maximum(0.0, ponds.held[full] - ponds.sums(pooled[m], ponds.sizes[full]) / 1000 * area)
            if pooled.any():
                land.take(pooled)
                infiltrated += pooled / 1000 * area
                most, free = np.maximum(0.0, most - pooled), np.maximum(0.0, free - pooled)
            routed = arriving[step].copy()
            for wave, spills in zip(waves, spilling, strict=True):
                local, come = rain[wave], routed[wave]
                runon[wave] += come
                there = local + come
                supply = there / area * 1000
                mm = np.minimum.reduce([supply, most[wave], free[wave]])
                inside = mm / 1000 * area
                infiltrated[wave] += inside
                share = np.divide(inside, there, out=np.zeros(len(wave)), where=there > 0)
                local_in[wave] += local * share
                land.take(mm, wave)
                left = np.where(there > 0, local * (1 - share), 0.0)
                local_out[wave] += left
                full = (free[wave] <= most[wave] + 1e-9) & (supply > free[wave] + 1e-9)
                saturated[wave] += np.where(full, left, 0.0)
                out = np.maximum(0.0, there - inside)
                if len(spills):
                    out[spills] = ponds.catch(wave[spills], out[spills])
                flow[wave] += out
                sent[step, wave] = out
                down = to[wave] >= 0
                np.add.at(routed, to[wave][down], out[down])
            land.drain(dt / 2)
        ponded, share_of = zero(), zero()
        full, m, deep = ponds.depths()
        ponded[m] = deep
        share_of[m[np.cumsum(ponds.sizes[full]) - ponds.sizes[full]]] = ponds.held[full]
        mm = lambda v: v / area * 1000
        pct = lambda v: 100 * np.clip(v / np.maximum(land.theta_s, 1e-6), 0.0, 1.0)
        leaving = (to < 0) & cells["to"].notna().to_numpy()
        return pd.DataFrame(
            {
                "row": cells["row"], "col": cells["col"], "local_runoff_mm": mm(local_out), "infiltration_mm": mm(infiltrated), "local_infiltration_mm": mm(local_in),
                "root_zone_storage_mm": land.stored, "deep_drainage_mm": land.drained, "saturation_excess_mm": mm(saturated), "saturation_pct": pct(land.theta), "initial_saturation_pct": pct(land.first),
                "ponded_water_mm": ponded * 1000, "input_m3": rain * steps, "runon_m3": runon, "flow_m3": flow, "outflow_m3": np.where(cells["to"].isna(), flow, 0.0), "pond_m3": share_of,
                "to": cells["to"].astype("Int64"), "series": [list(sent[:, i]) if leaving[i] else None for i in range(n)],
            }
        )

    return run


def step_count(hours: float) -> int:
    return max(LEAST_STEPS, int(np.ceil(hours / MOST_STEP_HOURS)))


def _packs(graph: DataFrame) -> DataFrame:
    """``chunk, pack, alone``: small chunks of a depth share tasks of about CHUNK cells, as every outlet has a chunk and most are small."""
    sizes = graph.groupBy("depth", "chunk").agg(F.count("*").alias("n")).withColumn("alone", F.col("n") >= CHUNK // 4)
    packs = sizes.where("not alone").groupBy("depth").agg(F.ceil(F.sum("n") / CHUNK).alias("packs"))
    pack = F.when(F.col("alone"), F.col("chunk")).otherwise(F.pmod(F.xxhash64("chunk"), "packs"))
    return sizes.join(packs, "depth", "left").select("chunk", pack.alias("pack"), "alone")


def coupled_event(graph: DataFrame, state: DataFrame, hours: float, cell_area: float, steps: int | None = None) -> DataFrame:
    """The event on every cell: ``row, col``, the depths of DEPTHS and the volumes of VOLUMES.

    ``graph`` comes from ``drainage``, ``state`` from ``hydraulic_state`` with ``p_mm``, what falls on the cell over ``hours`` hours (null: none). Raises
    if the water that came does not equal, to 1e-8, what the soil holds, has drained, stands in ponds and has left.
    """
    steps = steps or step_count(hours)
    cells = checkpointed(graph.join(state.drop("texture"), ["row", "col"]).join(_packs(graph), "chunk"))
    deepest = cells.agg(F.max("depth")).first()[0]
    spec = "row long, col long, " + ", ".join(f"{n} double" for n in DEPTHS + VOLUMES) + ", to long, series array<double>"
    where_to = cells.select(F.col("c").alias("to"), F.col("pack").alias("under"), F.col("alone").alias("under_alone"))
    # few bytes mean much work here: packs are dealt over all partitions, which are not merged by their size
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, "pack", "alone").groupBy("pack", "alone")
    done, series = [], None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        part = dealt(cells.where(F.col("depth") == depth))
        if series is None:
            series = cells.sparkSession.range(0).select(F.col("id").alias("pack"), F.lit(False).alias("alone"), F.col("id").alias("c"), F.array(F.lit(0.0)).alias("series"))
        found = checkpointed(part.cogroup(dealt(series)).applyInPandas(_event(hours, steps, cell_area), spec))
        done.append(found)
        series = found.where("series is not null").join(where_to, "to").select(F.col("under").alias("pack"), F.col("under_alone").alias("alone"), F.col("to").alias("c"), "series")
    result = cells.limit(0).sparkSession.createDataFrame([], spec) if not done else done[0]
    for more in done[1:]:
        result = result.union(more)
    check = result.agg(F.sum("input_m3").alias("came"), (F.sum((F.col("root_zone_storage_mm") + F.col("deep_drainage_mm")) / 1000 * cell_area) + F.sum("outflow_m3") + F.sum("pond_m3")).alias("known")).first()
    if check["came"] is not None and abs(check["came"] - check["known"]) > 1e-8 * max(check["came"], 1e-12):
        raise ArithmeticError(f"the water budget does not close: {check['came']!r} m3 came, {check['known']!r} are known of")
    return result.drop("to", "series")


def presets(years: DataFrame) -> DataFrame:
    """One row of inches for scenarios from water years (``peak_swe_mm, storm_1day_mm, storm_3day_mm``): medians, 90th percentiles, largest."""
    inch = lambda c: F.round(c / INCH, 1)
    at = lambda c, p: inch(F.percentile(c, F.lit(p)))
    return years.agg(
        at("peak_swe_mm", 0.5).alias("median_in"), at("peak_swe_mm", 0.9).alias("p90_in"), inch(F.max("peak_swe_mm")).alias("max_in"),
        at("storm_1day_mm", 0.5).alias("storm_1day_median_in"), at("storm_1day_mm", 0.9).alias("storm_1day_p90_in"), inch(F.max("storm_1day_mm")).alias("storm_1day_max_in"),
        inch(F.max("storm_3day_mm")).alias("storm_3day_max_in"), F.count("*").alias("n_water_years"),
    )


def forcing(mode: str, rain_in: float | None = None, swe_in: float | None = None, storm_hours: float = 12.0, melt_days: float = 4.0, known: dict | None = None, preset: str | None = None) -> dict:
    """``p_mm, hours, peaking, label`` of a rain or snowmelt scenario; what is not given comes from ``known`` presets, else a default."""
    known = known or {}
    if mode == "rain":
        hours = min(MOST_STORM_HOURS, max(0.5, storm_hours))
        rain = rain_in if rain_in is not None else known.get("storm_1day_median_in") or 2.0
        peak = 3.5 if hours <= 3 else 2.5 if hours <= 12 else 2.0 if hours <= 24 else 1.5
        return {"p_mm": rain * INCH, "hours": hours, "peaking": peak, "label": f"{rain:.1f} in rain / " + (f"{hours:.0f} h" if hours < 48 else f"{hours / 24:.0f} d")}
    if mode != "snowmelt":
        raise QueryError("unknown mode", mode=mode, known=["rain", "snowmelt"])
    days = min(MOST_MELT_DAYS, max(0.5, melt_days))
    swe = swe_in if swe_in is not None else known.get(f"{preset or 'median'}_in", 7.0)
    rain = rain_in or 0.0
    return {"p_mm": (swe + rain) * INCH, "hours": days * 24, "peaking": 2.0, "label": f"{swe:.1f} in SWE / {days:.0f} d melt" + (f" + {rain:.1f} in rain" if rain else "")}


def summary(event: DataFrame, hours: float, peaking: float, cell_area: float) -> DataFrame:
    """One row: volumes and mean depths of an event, mean and peak discharge at all outlets (m3/s), and whether the share of water left on the
    surface is too small to tell."""
    c, v = F.col, lambda n: F.sum(n)
    one = event.agg(
        F.count("*").alias("cells"), v("input_m3").alias("input_m3"), v("outflow_m3").alias("outflow_m3"), v("pond_m3").alias("ponded_m3"),
        *[F.avg(n).alias("mean_" + n) for n in DEPTHS if n != "ponded_water_mm"], *[(F.sum(n) / 1000 * cell_area).alias(n.replace("_mm", "_m3")) for n in ("infiltration_mm", "root_zone_storage_mm", "deep_drainage_mm")],
    )
    left = c("outflow_m3") + c("ponded_m3")
    return one.select(
        "*", left.alias("surface_m3"), (left / (c("cells") * cell_area) * 1000).alias("mean_surface_mm"), (c("outflow_m3") / (hours * 3600)).alias("mean_m3s"), (c("outflow_m3") / (hours * 3600) * peaking).alias("peak_m3s"),
        (left / F.greatest(c("input_m3"), F.lit(1e-12)) < LEAST_SHARE).alias("below_resolution"),
    )


def readings(event: DataFrame, points: DataFrame, grid: raster.Grid, point_id: str) -> DataFrame:
    """The event at points (``x, y``), one row each with a sentence; points off the grid are left out."""
    at = points.select(point_id, grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).join(event, ["row", "col"])
    told: Column = F.format_string("%.1f mm infiltrated, %.1f mm stayed in the soil, %.1f mm drained below it", "infiltration_mm", "root_zone_storage_mm", "deep_drainage_mm")
    pond = F.when(F.col("ponded_water_mm") > 0.5, F.format_string("; water stands %.0f mm deep", "ponded_water_mm")).otherwise(F.lit(""))
    return at.select(point_id, *DEPTHS, "flow_m3", F.concat(told, pond).alias("sentence"))
