"""Evapotranspiration and daily water balance as Column expressions (FAO-56 forms)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Solar constant, Stefan-Boltzmann, latent heat, albedo.
GSC, SIGMA, LATENT, ALBEDO = 0.0820, 4.903e-9, 2.45, 0.23
# Depletion fraction, crop coefficient range, snow threshold, degree-day factor, snowpack threshold.
P_FRACTION, KCB_MIN, KCB_MAX, SNOW_T, DDF, PACK_MM = 0.5, 0.25, 0.95, 0.5, 4.0, 5.0


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))


def saturation_pressure(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def pressure_slope(t: Column) -> Column:
    return 4098 * saturation_pressure(t) / ((t + 237.3) * (t + 237.3))


def air_pressure(elevation: float) -> float:
    return 101.3 * ((293 - 0.0065 * elevation) / 293) ** 5.26


def wind_at_2m(u10: Column) -> Column:
    """Wind at 10 m brought to 2 m by the logarithmic profile."""
    return u10 * (4.87 / math.log(67.8 * 10 - 5.42))


def extraterrestrial(lat_deg: float | Column, yday: Column) -> Column:
    phi = F.radians(lat_deg if isinstance(lat_deg, Column) else F.lit(lat_deg))
    dr = 1 + 0.033 * F.cos(2 * math.pi / 365 * yday)
    dec = 0.409 * F.sin(2 * math.pi / 365 * yday - 1.39)
    ws = F.acos(clamp(-F.tan(phi) * F.tan(dec), -1, 1))
    return 24 * 60 / math.pi * GSC * dr * (ws * F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.sin(ws))


def day_length(lat_deg: float | Column, yday: Column) -> Column:
    phi = F.radians(lat_deg if isinstance(lat_deg, Column) else F.lit(lat_deg))
    dec = 0.409 * F.sin(2 * math.pi / 365 * yday - 1.39)
    return 24 / math.pi * F.acos(clamp(-F.tan(phi) * F.tan(dec), -1, 1))


def net_radiation(rs: Column, ra: Column, tmin: Column, tmax: Column, ea: Column, elevation: float) -> Column:
    clear = (0.75 + 2e-5 * elevation) * ra
    cloud = clamp(F.when(clear > 0, rs / clear).otherwise(F.lit(0.3)), 0.3, 1.0)
    fourth = lambda t: F.pow(t + 273.16, F.lit(4.0))
    out = SIGMA * (fourth(tmax) + fourth(tmin)) / 2 * (0.34 - 0.14 * F.sqrt(ea)) * (1.35 * cloud - 0.35)
    return (1 - ALBEDO) * rs - out


def et0(tmin: Column, tmax: Column, rs: Column, ea: Column, yday: Column, lat_deg: float, elevation: float, u2: Column | None = None) -> dict[str, Column]:
    """Reference evapotranspiration by four methods, in mm a day, none below zero, with their mean and spread."""
    t = (tmin + tmax) / 2
    ra = extraterrestrial(lat_deg, yday)
    rn = net_radiation(rs, ra, tmin, tmax, ea, elevation)
    delta, gamma = pressure_slope(t), 0.665e-3 * air_pressure(elevation)
    u = u2 if u2 is not None else F.lit(2.0)
    es = (saturation_pressure(tmin) + saturation_pressure(tmax)) / 2
    floor = lambda c: F.greatest(c, F.lit(0.0))
    found = {
        "oudin": floor(ra / LATENT * F.greatest(t + 5, F.lit(0.0)) / 100),
        "hargreaves": floor(0.0023 * 0.408 * ra * (t + 17.8) * F.sqrt(floor(tmax - tmin))),
        "priestley_taylor": floor(1.26 * delta / (delta + gamma) * rn / LATENT),
        "penman_monteith": floor((0.408 * delta * rn + gamma * 900 / (t + 273) * u * floor(es - ea)) / (delta + gamma * (1 + 0.34 * u))),
    }
    four = list(found.values())
    return found | {"mean": sum(four[1:], four[0]) / 4, "spread": F.greatest(*four) - F.least(*four)}


def kcb(yday: Column) -> Column:
    """Seasonal basal crop coefficient: dormant, rising, full, falling."""
    up, down = (yday - 95) / F.lit(70.0), (F.lit(315) - yday) / F.lit(55.0)
    span = KCB_MAX - KCB_MIN
    return F.when((yday < 95) | (yday > 315), F.lit(KCB_MIN)).when(yday < 165, KCB_MIN + span * up).when(yday <= 260, F.lit(KCB_MAX)).otherwise(KCB_MIN + span * down)


def budyko_fu(aridity: Column, omega: float = 2.6) -> Column:
    """Share of precipitation that evaporates, by Fu's curve, kept in 0..1."""
    return clamp(1 + aridity - F.pow(1 + F.pow(aridity, F.lit(omega)), F.lit(1 / omega)), 0, 1)


def trailing_wetness(days: DataFrame, site: str = "site", day: str = "day", water: str = "p_eff") -> DataFrame:
    """Sums of the last 5, 14 and 30 rows over 25, 60 and 110 mm, at most 1."""
    w = Window.partitionBy(site).orderBy(day)
    cols = [F.least(F.sum(water).over(w.rowsBetween(1 - n, 0)) / scale, F.lit(1.0)).alias(f"wetness_{n}d") for n, scale in ((5, 25.0), (14, 60.0), (30, 110.0))]
    return days.select("*", *cols)


def antecedent(root: Column, w5: Column, w14: Column, w30: Column) -> Column:
    return 0.45 * root + 0.25 * w5 + 0.20 * w14 + 0.10 * w30


STATE = "snow double, dr double"


def bucket(days: DataFrame, taw: float, canopy: float, start: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Daily soil-water bucket of each site: ``site, day, prcp, tmean, et0, yday`` to fluxes and state.

    A fold over each site's days in order; sites are independent. Columns: ``aet, runoff, recharge, melt, snow, dr``.
    """
    one = F.collect_list(F.struct("day", "prcp", "tmean", "et0", "yday"))
    kinds = "struct<day:date,aet:double,runoff:double,recharge:double,melt:double,snow:double,dr:double>"
    series = days.groupBy("site").agg(F.sort_array(one).alias("days"))

    def step(acc: Column, x: Column) -> Column:
        cold = x["tmean"] <= SNOW_T
        snow_in = acc["snow"] + F.when(cold, x["prcp"]).otherwise(0.0)
        melt = F.least(snow_in, F.when(x["tmean"] > 0, DDF * x["tmean"]).otherwise(0.0))
        pack = snow_in - melt
        held = F.least(F.least(x["prcp"], F.lit(0.6 + 1.6 * canopy)), x["et0"] * (0.10 + 0.15 * canopy))
        sub = F.when(pack > PACK_MM, F.least(F.least(0.12 * x["et0"], F.lit(0.6)), pack)).otherwise(0.0)
        rain = F.when(cold, 0.0).otherwise(x["prcp"])
        runoff = 0.04 * F.greatest(rain + melt - 8, F.lit(0.0)) + 0.18 * F.greatest(rain + melt - 35, F.lit(0.0))
        water = F.greatest(rain + melt - runoff - held, F.lit(0.0))
        ks = clamp((taw - acc["dr"]) / ((1 - P_FRACTION) * taw), 0, 1)
        crop = F.when(pack > PACK_MM, 0.0).otherwise(ks * kcb(x["yday"]) * x["et0"])
        dr = acc["dr"] + crop - water
        recharge = F.greatest(-dr, F.lit(0.0))
        left = clamp(dr, 0, taw)
        aet = crop + held + sub
        row = F.struct(x["day"].alias("day"), aet.alias("aet"), runoff.alias("runoff"), recharge.alias("recharge"), melt.alias("melt"), (pack - sub).alias("snow"), left.alias("dr")).cast(kinds)
        return row

    def fold(acc: Column, x: Column) -> Column:
        from landloom.functions.geo import bind

        return bind(step(acc["state"], x), lambda r: F.struct(r.alias("state"), F.array_append(acc["out"], r).alias("out")))

    zero = F.lit(0.0)
    first = F.struct(F.lit(None).cast("date").alias("day"), *[zero.alias(n) for n in ("aet", "runoff", "recharge", "melt")], F.lit(start[0]).alias("snow"), F.lit(start[1]).alias("dr")).cast(kinds)
    begin = F.struct(first.alias("state"), F.array().cast(f"array<{kinds}>").alias("out"))
    return series.select("site", F.explode(F.aggregate("days", begin, fold)["out"]).alias("r")).select("site", "r.*")


def water_year(day: Column) -> Column:
    """Year of the water year that a day belongs to; it turns on 1 October."""
    return F.year(day) + F.when(F.month(day) >= 10, 1).otherwise(0)
