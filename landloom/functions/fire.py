"""Surface and crown fire behaviour as Column expressions (Rothermel, Byram, Van Wagner)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .climate import clamp

#: Weather presets as (deg F, % RH, mph, days since rain, drought).
PRESETS = {
    "normal_spring": (60, 45, 8, 5, "normal"),
    "high_spring": (68, 30, 15, 10, "dry"),
    "extreme_redflag": (78, 15, 25, 21, "severe"),
    "summer_drought": (85, 25, 18, 14, "extreme"),
    "dormant_fall": (55, 30, 12, 8, "normal"),
}
#: Fixed values: (herbaceous, woody) live moisture in % by class.
LIVE = {1: (30, 60), 2: (60, 90), 3: (90, 120), 4: (120, 150)}


def equilibrium_moisture(t_f: Column, rh: Column) -> Column:
    """Equilibrium moisture of fine dead fuel in %, in three bands of humidity."""
    dry = 0.03229 + 0.281073 * rh - 0.000578 * rh * t_f
    mid = 2.22749 + 0.160107 * rh - 0.01478 * t_f
    wet = 21.0606 + 0.005565 * rh * rh - 0.00035 * rh * t_f - 0.483199 * rh
    return F.when(rh < 10, dry).when(rh < 50, mid).otherwise(wet)


def growing_season_index(tmin_c: Column, vpd_pa: Column, day_h: Column) -> Column:
    ramp = lambda v, lo, hi: clamp((v - lo) / F.lit(float(hi - lo)), 0, 1)
    return ramp(tmin_c, -2, 5) * (1 - ramp(vpd_pa, 900, 4100)) * ramp(day_h, 10, 11)


def wind_adjustment(cover_pct: Column) -> Column:
    """Share of the open wind that reaches the flames, by canopy cover."""
    return F.when(cover_pct <= 5, 0.40).when(cover_pct <= 10, 0.30).when(cover_pct <= 15, 0.25).when(cover_pct <= 30, 0.20).when(cover_pct <= 50, 0.15).otherwise(0.10)


def curing(live_herb: Column) -> Column:
    """Share of the herbaceous load that burns as dead, from its moisture fraction."""
    return clamp((1.20 - live_herb) / 0.90, 0, 1)


def rothermel(load: Column, sav: Column, depth: Column, extinction: Column, moisture: Column, wind_ms: Column, slope_tan: Column, heat: float = 18608.0) -> Column:
    """Rate of spread in m/min of a one-class fuel bed, in Rothermel's units (lb, ft, min) inside.

    ``load`` kg/m2, ``sav`` 1/m, ``depth`` m, moistures as fractions, midflame wind m/s, slope as a tangent. The wind factor is
    capped where effective wind exceeds 0.9 of the reaction intensity. Null loads and empty beds do not burn.
    """
    w0, s, d, h = load * 0.204816, sav * 0.3048, depth * 3.28084, heat * 0.000429923
    rho = w0 / d
    beta = rho / 32.0
    best = 3.348 * F.pow(s, F.lit(-0.8189))
    ratio = beta / best
    a = 133.0 * F.pow(s, F.lit(-0.7913))
    top = F.pow(s, F.lit(1.5)) / (495.0 + 0.0594 * F.pow(s, F.lit(1.5)))
    gamma = top * F.pow(ratio, a) * F.exp(a * (1 - ratio))
    rm = F.least(moisture / extinction, F.lit(1.0))
    damp = 1 - 2.59 * rm + 5.11 * rm * rm - 3.52 * rm * rm * rm
    intensity = gamma * (w0 * (1 - 0.0555)) * h * F.greatest(damp, F.lit(0.0)) * 0.174 * math.pow(0.01, -0.19)
    flux = F.exp((0.792 + 0.681 * F.sqrt(s)) * (beta + 0.1)) / (192.0 + 0.2595 * s)
    u = F.least(wind_ms * 196.85, 0.9 * intensity)
    c, b, e = 7.47 * F.exp(-0.133 * F.pow(s, F.lit(0.55))), 0.02526 * F.pow(s, F.lit(0.54)), 0.715 * F.exp(-3.59e-4 * s)
    phi_w = c * F.pow(F.greatest(u, F.lit(0.0)), b) * F.pow(ratio, -e)
    phi_s = 5.275 * F.pow(beta, F.lit(-0.3)) * slope_tan * slope_tan
    sink = rho * F.exp(-138.0 / s) * (250.0 + 1116.0 * moisture)
    return F.when((load > 0) & (depth > 0) & (sav > 0), intensity * flux * (1 + phi_w + phi_s) / sink * 0.3048).otherwise(0.0)


def byram_intensity(heat_kj: Column, load: Column, ros_m_min: Column) -> Column:
    return heat_kj * load * ros_m_min / 60


def flame_length(intensity: Column, crown: bool = False) -> Column:
    return 0.0266 * F.pow(intensity, F.lit(0.667)) if crown else 0.0775 * F.pow(intensity, F.lit(0.46))


def crown_class(intensity: Column, base_height: Column, foliar_moisture: Column, crown_ros: Column, bulk_density: Column) -> Column:
    """surface, passive or active: Van Wagner's critical intensity and critical spread 3 / bulk density."""
    critical = F.pow(0.010 * base_height * (460 + 25.9 * foliar_moisture), F.lit(1.5))
    return F.when(intensity < critical, "surface").when(crown_ros >= 3 / bulk_density, "active").otherwise("passive")


def ellipse_ratio(wind_mph: Column) -> Column:
    return clamp(0.936 * F.exp(0.2566 * wind_mph) + 0.461 * F.exp(-0.1548 * wind_mph) - 0.397, 1, 8)


def directional_spread(head: Column, ratio: Column, theta: Column) -> Column:
    """Spread at an angle from the direction of the head, on an ellipse with the fire at its rear focus."""
    e = F.sqrt(1 - 1 / (ratio * ratio))
    return head * (1 - e) / (1 - e * F.cos(theta))


def hydro_level(twi_pct: Column, pond_m: Column, seep: Column, flow_ha: Column) -> Column:
    """The strongest wetness signal of a cell as ``struct<level, score>``; the stronger level wins, then the score."""
    sig = lambda test, level, score: F.when(test, F.struct(F.lit(level).alias("level"), F.lit(score).alias("score")))
    return F.greatest(
        sig((twi_pct >= 75) & (twi_pct < 90), 1, 0.55), sig((twi_pct >= 90) & (twi_pct < 95), 2, 0.80), sig(twi_pct >= 95, 3, 1.0),
        sig((pond_m > 0) & (pond_m < 0.05), 3, 0.85), sig(pond_m >= 0.05, 4, 1.0), sig((seep >= 60) & (seep < 80), 2, 0.8), sig(seep >= 80, 3, 1.0),
        sig((flow_ha >= 0.03) & (flow_ha < 0.10), 1, 0.45), sig(flow_ha >= 0.10, 1, 0.65), F.struct(F.lit(0).alias("level"), F.lit(0.0).alias("score")),
    )


#: By exposure, the shift of the equilibrium moisture in % and the speed of drying.
EXPOSURES = {"shaded": (0.0, 1.0), "mixed": (-1.0, 1.15), "open": (-2.0, 1.30)}
#: Shift of the foliar moisture in % by drought.
DROUGHTS = {"normal": 0.0, "dry": 0.0, "moderate": 0.0, "severe": -5.0, "extreme": -10.0, "catastrophic": -10.0}


def dead_moisture(t_f: Column, rh: Column, days: Column, exposure: str = "shaded") -> dict[str, Column]:
    """Moisture fractions of dead fuels of 1, 10 and 100 hours, drying towards equilibrium since the last rain."""
    shift, speed = EXPOSURES[exposure]
    e = clamp(equilibrium_moisture(t_f, rh) + shift, 1, 100)
    d = F.greatest(days, F.lit(0.0))
    curve = lambda end, wet, lag: end + (wet - end) * F.exp(-24.0 * d * speed / lag)
    return {"m1": clamp(curve(e, 35.0, 1.0), 2, 35) / 100, "m10": clamp(curve(e + 2, 35.0, 10.0), 3, 35) / 100, "m100": clamp(curve(e + 4, 30.0, 100.0), 4, 40) / 100}


def live_moisture(gsi: Column) -> dict[str, Column]:
    """Herbaceous and woody moisture in % from a mean growing season index; dormant up to one half."""
    g = clamp(gsi, 0, 1)
    return {"herb": F.when(g > 0.5, 440 * g - 190).otherwise(30.0), "woody": F.when(g > 0.5, 280 * g - 80).otherwise(60.0)}


def foliar_moisture(lat: Column, lon_west: Column, elevation: Column, yday: Column, drought: str = "normal") -> Column:
    """Conifer foliar moisture in % around the day of its spring low."""
    high = elevation > 0
    norm = F.when(high, 43 + 33.7 * F.exp(-0.0351 * (150 - lon_west))).otherwise(46 + 23.4 * F.exp(-0.0360 * (150 - lon_west)))
    low = F.rint(F.when(high, 142.1 * (lat / norm) + 0.0172 * elevation).otherwise(151.0 * (lat / norm)))
    n = F.abs(yday - low)
    found = F.when(n < 30, 85 + 0.0189 * n * n).when(n < 50, 32.9 + 3.17 * n - 0.0288 * n * n).otherwise(120.0)
    return clamp(found + DROUGHTS[drought], 75 if drought == "catastrophic" else 80, 120)


def midflame_wind(open_wind: Column, cover: Column) -> Column:
    """Open wind cut down by canopy cover, given as a fraction or in %; missing cover is none."""
    share = F.coalesce(F.when(F.isnan(cover), 0.0).otherwise(cover), F.lit(0.0))
    share = clamp(F.when(share > 1, share / 100).otherwise(share), 0, 1)
    return F.greatest(open_wind, F.lit(0.0)) * wind_adjustment(share * 100)


def ellipse_rates(head: Column, ratio: Column) -> dict[str, Column]:
    """Spread at the flank and the back of an ellipse of length ``ratio`` to width."""
    e = F.sqrt(F.greatest(1 - 1 / (ratio * ratio), F.lit(0.0)))
    return {"flank": head * F.sqrt((1 - e) / (1 + e)), "back": head * (1 - e) / (1 + e)}


def ember_reach(wind_mph: float, flame: float, passive: bool, active: bool) -> float:
    """How far downwind embers are reckoned with, in metres; none under a mile an hour."""
    base = max(120.0 if flame >= 2.4 else 60.0, 180.0 if passive else 0.0, 320.0 if active else 0.0)
    return min(800.0, base * min(max(wind_mph / 20, 0.5), 2.5)) if wind_mph >= 1 else 0.0
