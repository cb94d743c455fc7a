"""Fuel beds of five size classes, surface spread over them, crown spread and the winds at which crowns burn.

A fuel table has a row per ``code``: loads ``dead_1h, dead_10h, dead_100h, herb, woody`` in kg/m2, ``sav_`` of each in 1/m,
``depth`` in m, dead ``extinction``, ``heat`` in kJ/kg, ``burnable`` and ``dynamic``. Constants of a bed are made once per
code; cells join them. The table is a parameter, so any set of fuel models will do. Beds and reactions are tables of their own in the
shared folder: their columns build on each other, and a filter pushed down through them would repeat each of them many times over.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.session import checkpointed

from ..functions.climate import clamp
from ..functions.fire import curing

DEAD, LIVE = ("dead_1h", "dead_10h", "dead_100h"), ("herb", "woody")
CLASSES = DEAD + LIVE
#: Lower bounds of the size classes in 1/ft, finest first.
SIZES = (1200.0, 192.0, 96.0, 48.0, 16.0)
#: lb/ft2 of kg/m2, ft of m, Btu/lb of kJ/kg, kW/m2 of Btu/ft2/min, m/min of mph.
LB, FT, BTU, KW, MPH = 0.204816143622, 3.280839895, 1 / 2.3259999996, 0.189273025894, 26.8224
#: The timber litter bed that active crown fire is reckoned on, in t/ac, 1/ft, ft and Btu/lb.
CROWN_BED = {"load": (3.01, 2.00, 5.01, 0.0, 2.00), "sav": (2000.0, 109.0, 30.0, 0.0, 1500.0), "depth": 1.0, "extinction": 0.25, "heat": 8000.0}
#: Winds are sought up to this many mph; open wind reaches the flames of an unsheltered bed by this share.
MAX_WIND, OPEN_SHARE = 120.0, 0.40


def _over(a, b) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def crown_fuel(spark) -> DataFrame:
    """The one-row fuel table of ``CROWN_BED``."""
    load = {k: v * 0.224170231 for k, v in zip(CLASSES, CROWN_BED["load"])}
    sav = {f"sav_{k}": v * FT for k, v in zip(CLASSES, CROWN_BED["sav"])}
    rest = {"depth": CROWN_BED["depth"] * 0.3048, "extinction": CROWN_BED["extinction"], "heat": CROWN_BED["heat"] / BTU}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in {**load, **sav, **rest}.items()], F.lit(True).alias("burnable"), F.lit(False).alias("dynamic"))


def with_fuel(cells: DataFrame, fuels: DataFrame) -> DataFrame:
    """``cells`` with the parameters of their ``code``. Codes the table lacks, and null ones, do not burn."""
    found = cells.join(fuels, "code", "left")
    return found.withColumns({"burnable": F.coalesce("burnable", F.lit(False)), "dynamic": F.coalesce("dynamic", F.lit(False))})


def cured(fuels: DataFrame, live_herb: Column) -> DataFrame:
    """Dynamic fuels with the cured share of their herbs moved to the finest dead class, whose surface is weighed by load."""
    moved = F.when(F.col("dynamic"), F.col("herb") * curing(live_herb)).otherwise(0.0)
    total = F.col("dead_1h") + moved
    surface = F.when(total > 0, (F.col("dead_1h") * F.col("sav_dead_1h") + moved * F.col("sav_herb")) / total).otherwise(F.col("sav_dead_1h"))
    return fuels.withColumns({"dead_1h": total, "sav_dead_1h": surface, "herb": F.greatest(F.col("herb") - moved, F.lit(0.0))})


def beds(fuels: DataFrame, prefix: str = "") -> DataFrame:
    """Constants of the beds of (cured) fuels, named after ``prefix``; other columns of the table stay.

    Weights by surface area, packing, the wind and slope factors' scales, reaction velocity and flux ratio. A class without load
    or surface weighs nothing; a bed without load or depth does not burn.
    """
    c = F.col
    kinds = (("dead", DEAD), ("live", LIVE))
    b = fuels.withColumns({f"w_{k}": c(k) * LB for k in CLASSES} | {f"s_{k}": c(f"sav_{k}") * (1 / FT) for k in CLASSES})
    size = lambda k: reduce(lambda rest, i: F.when(c(f"s_{k}") >= SIZES[i], i).otherwise(rest), reversed(range(len(SIZES))), F.lit(len(SIZES)))
    b = b.withColumns({f"area_{k}": c(f"s_{k}") * c(f"w_{k}") / 32.0 for k in CLASSES} | {f"size_{k}": size(k) for k in CLASSES})
    b = b.withColumns({f"area_{kind}": _sum(c(f"area_{k}") for k in of) for kind, of in kinds})
    b = b.withColumns({f"f_{k}": _over(c(f"area_{k}"), c(f"area_{kind}")) for kind, of in kinds for k in of})
    share = {f"f_{kind}": _over(c(f"area_{kind}"), c("area_dead") + c("area_live")) for kind, _ in kinds}
    same = lambda k, of: _sum(F.when(c(f"size_{k}") == c(f"size_{o}"), c(f"f_{o}")).otherwise(0.0) for o in of)
    net = {f"net_{kind}": _sum(same(k, of) * c(f"w_{k}") * (1 - 0.0555) for k in of) for kind, of in kinds}
    loaded = _sum(c(f"w_{k}") for k in CLASSES)
    b = b.withColumns(share | net | {"density": _over(loaded, c("depth") * FT)})
    sigma = _sum(c(f"f_{kind}") * _sum(c(f"f_{k}") * c(f"s_{k}") for k in of) for kind, of in kinds)
    b = b.withColumns({"sigma": sigma, "packing": c("density") / 32.0})
    s = c("sigma")
    b = b.withColumns({
        "relative": F.when(s > 0, c("packing") / (3.348 * F.pow(s, F.lit(-0.8189)))).otherwise(0.0), "wind_power": F.when(s > 0, 0.02526 * F.pow(s, F.lit(0.54))).otherwise(0.0),
        "a": F.when(s > 0, 133.0 * F.pow(s, F.lit(-0.7913))).otherwise(0.0), "e": F.when(s > 0, 0.715 * F.exp(-3.59e-4 * s)).otherwise(0.0),
        "residence": _over(F.lit(384.0), s),
    })
    r, lives = c("relative"), (c("relative") > 0) & (s > 0)
    b = b.withColumns({
        "wind_scale": F.when(lives, 7.47 * F.exp(-0.133 * F.pow(s, F.lit(0.55))) * F.pow(r, -c("e")) * F.pow(F.lit(FT), c("wind_power"))).otherwise(0.0),
        "slope_scale": F.when(c("packing") > 0, 5.275 * F.pow(c("packing"), F.lit(-0.3))).otherwise(0.0),
        "velocity": F.when(lives, F.pow(s, F.lit(1.5)) / (495.0 + 0.0594 * F.pow(s, F.lit(1.5))) * F.pow(r, c("a")) * F.exp(c("a") * (1 - r))).otherwise(0.0),
        "flux": F.when(s > 0, F.exp((0.792 + 0.681 * F.sqrt(s)) * (c("packing") + 0.1)) / (192.0 + 0.2595 * s)).otherwise(0.0),
        "burns": c("burnable") & (c("depth") > 0) & (loaded > 0),
    })
    keep = [f"{p}_{k}" for k in CLASSES for p in "wsf"] + ["f_dead", "f_live", "net_dead", "net_live", "density", "sigma", "packing", "relative", "wind_power", "wind_scale", "slope_scale", "velocity", "flux", "residence", "burns"]
    fuel = {"extinction", "heat"}
    other = [f for f in fuels.columns if f not in fuel]
    return checkpointed(b.select(*(other if not prefix else []), *[c(k).alias(prefix + k) for k in [*keep, *sorted(fuel)]]))


def reaction(cells: DataFrame, prefix: str = "") -> DataFrame:
    """``cells`` that carry a bed and moistures ``m_dead_1h`` to ``m_woody`` with ``reaction`` in Btu/ft2/min and ``base_ros`` in m/min.

    Both are 0 where the bed does not burn or its dead fuel is at its moisture of extinction. Null moistures give 0.
    """
    c = lambda n: F.col(prefix + n)
    m = {k: clamp(F.col(f"m_{k}"), 0, 5) for k in CLASSES}
    fine = lambda k, at: F.when(c(f"s_{k}") > 0, F.exp(at / c(f"s_{k}"))).otherwise(0.0)
    name = lambda n: f"_{prefix}{n}"
    dead_load = _sum(c(f"w_{k}") * fine(k, -138.0) for k in DEAD)
    out = cells.withColumns({
        name("dead"): dead_load, name("live"): _sum(c(f"w_{k}") * fine(k, -500.0) for k in LIVE), name("wet"): _sum(m[k] * c(f"w_{k}") * fine(k, -138.0) for k in DEAD),
        name("m_dead"): _sum(c(f"f_{k}") * m[k] for k in DEAD), name("m_live"): _sum(c(f"f_{k}") * m[k] for k in LIVE),
        name("sink"): c("density") * _sum(c(f"f_{kind}") * _sum(c(f"f_{k}") * fine(k, -138.0) * (250.0 + 1116.0 * m[k]) for k in of) for kind, of in (("dead", DEAD), ("live", LIVE))),
    })
    t = lambda n: F.col(name(n))
    limit = c("extinction")
    live_limit = F.greatest(limit, 2.9 * _over(t("dead"), t("live")) * (1 - _over(_over(t("wet"), t("dead")), limit)) - 0.226)
    out = out.withColumn(name("limit"), F.when(t("live") > 0, live_limit).otherwise(limit))

    def damping(moisture: Column, at: Column) -> Column:
        r = F.least(_over(moisture, at), F.lit(1.0))
        return F.when(at > 0, F.greatest(1 - 2.59 * r + 5.11 * r * r - 3.52 * r * r * r, F.lit(0.0))).otherwise(0.0)

    mineral = 0.174 * math.pow(0.01, -0.19)
    power = (c("net_dead") * damping(t("m_dead"), limit) + c("net_live") * damping(t("m_live"), t("limit"))) * c("heat") * BTU * mineral * c("velocity")
    ok = c("burns") & (t("sink") > 0) & (t("m_dead") < limit)
    out = out.withColumn(prefix + "reaction", F.when(ok, F.coalesce(power, F.lit(0.0))).otherwise(0.0))
    base = F.when(c("reaction") > 0, c("reaction") * c("flux") / t("sink") * 0.3048).otherwise(0.0)
    return checkpointed(out.withColumn(prefix + "base_ros", base).drop(*[name(n) for n in ("dead", "live", "wet", "m_dead", "m_live", "sink", "limit")]))


def wind_factor(wind: Column, prefix: str = "") -> Column:
    """Wind factor of a midflame wind in m/min."""
    return F.col(prefix + "wind_scale") * F.pow(F.greatest(wind, F.lit(0.0)), F.col(prefix + "wind_power"))


def slope_factor(slope_tan: Column, prefix: str = "") -> Column:
    return F.col(prefix + "slope_scale") * F.pow(F.greatest(slope_tan, F.lit(0.0)), F.lit(2.0))


def factor_limit(prefix: str = "") -> Column:
    """The factor at which effective wind is 0.9 of the reaction intensity; beyond it spread does not grow."""
    return wind_factor(0.9 * F.col(prefix + "reaction") * 0.3048, prefix)


def with_wind_and_slope(cells: DataFrame, wind: Column, slope_tan: Column, aspect: Column, downwind: Column) -> DataFrame:
    """``factor``, ``effective_wind`` (m/min) and ``direction`` of spread: wind and upslope added as vectors, capped.

    Azimuths are degrees from north; ``aspect`` points downslope. Where nothing burns both are 0 and the direction is null.
    """
    out = cells.withColumns({"_w": wind_factor(wind), "_s": slope_factor(slope_tan)})
    up, down = F.radians(aspect + 180), F.radians(downwind)
    out = out.withColumns({"_x": F.col("_w") * F.sin(down) + F.col("_s") * F.sin(up), "_y": F.col("_w") * F.cos(down) + F.col("_s") * F.cos(up)})
    reach = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    live = F.col("burns") & (F.col("reaction") > 0)
    out = out.withColumn("factor", F.when(live, F.least(reach, factor_limit())).otherwise(0.0))
    effective = F.when(F.col("factor") > 0, F.pow(F.col("factor") / F.col("wind_scale"), 1 / F.col("wind_power"))).otherwise(0.0)
    direction = F.when(F.col("factor") > 0, F.pmod(F.degrees(F.atan2("_x", "_y")), F.lit(360.0)))
    return out.withColumns({"effective_wind": effective, "direction": direction}).drop("_w", "_s", "_x", "_y")


def spread(factor: Column, prefix: str = "") -> Column:
    """Rate of spread in m/min under a wind and slope factor, capped."""
    return F.col(prefix + "base_ros") * (1 + F.least(factor, factor_limit(prefix)))


def fireline_intensity(ros: Column) -> Column:
    """kW/m of a front that burns for the bed's residence time."""
    return F.col("reaction") * KW * F.col("residence") * ros


def active_crown_spread(open_mph: Column, slope_tan: Column, prefix: str = "crown_") -> Column:
    """Spread of active crown fire in m/min, from the crown bed that ``cells`` carry under ``prefix``."""
    return 3.34 * spread(wind_factor(open_mph * MPH * OPEN_SHARE, prefix) + slope_factor(slope_tan, prefix), prefix)


def _wind_for(ros: Column, slope_tan: Column, prefix: str = "") -> Column:
    """The open wind in mph at which a bed spreads at ``ros``: the wind factor turned round. Infinite if no wind up to MAX_WIND does."""
    need = ros / F.col(prefix + "base_ros") - 1
    more = need - slope_factor(slope_tan, prefix)
    mph = F.pow(more / F.col(prefix + "wind_scale"), 1 / F.col(prefix + "wind_power")) / (MPH * OPEN_SHARE)
    never = F.lit(float("inf"))
    found = F.when(need > factor_limit(prefix), never).when(more <= 0, 0.0).when(mph > MAX_WIND, never).otherwise(mph)
    return F.when(F.col(prefix + "base_ros") > 0, found).otherwise(never)


def has_crowns(base_height: Column, bulk_density: Column, foliar: Column) -> Column:
    """Where crown fire applies: a burning bed under a canopy with a base height, a density and a known foliar moisture."""
    return F.coalesce(F.col("burns") & (base_height > 0) & (bulk_density > 0) & foliar.isNotNull(), F.lit(False))


def torching_and_crowning(cells: DataFrame, base_height: Column, bulk_density: Column, foliar: Column, slope_tan: Column) -> DataFrame:
    """``torching`` and ``crowning``: the open winds in mph that light crowns and that carry fire through them.

    Cells carry their bed and the crown bed, both with their reaction. No crowns (no base height or density) or nothing to burn: null.
    Spread grows with wind alone, so the winds come from the formula turned round, without a search.
    """
    crowns = has_crowns(base_height, bulk_density, foliar)
    start = F.pow(0.010 * base_height * (460 + 25.9 * foliar), F.lit(1.5))
    per_ros = F.col("reaction") * KW * F.col("residence")
    torching = F.when(crowns, F.when(per_ros > 0, _wind_for(start / per_ros, slope_tan)).otherwise(float("inf")))
    carry = _wind_for(3.0 / bulk_density / 3.34, slope_tan, "crown_")
    return cells.withColumn("torching", torching).withColumn("crowning", F.when(crowns, F.greatest(F.col("torching"), carry)))
