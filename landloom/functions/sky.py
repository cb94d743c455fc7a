"""Sun, radiation and visibility as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .climate import clamp
from .geo import bind

EARTH = 6_371_000.0
#: Share of the earth's curvature that refraction takes back.
REFRACTION = {"optical": 1 / 7, "radio": 0.25, "none": 0.0}


def curvature_drop(distance: Column, kind: str = "optical") -> Column:
    return (1 - REFRACTION[kind]) * distance * distance / (2 * EARTH)


def fresnel_radius(d1_km: Column, d2_km: Column, ghz: float) -> Column:
    """Radius of the first Fresnel zone in metres."""
    return 17.3 * F.sqrt(d1_km * d2_km / (ghz * (d1_km + d2_km)))


def solar_position(lat_deg: float | Column, yday: Column, solar_hour: Column) -> Column:
    """``struct<elevation, azimuth>`` in degrees; azimuth from north over east."""
    phi = F.radians(lat_deg if isinstance(lat_deg, Column) else F.lit(lat_deg))
    dec = F.radians(23.45 * F.sin(F.radians(360.0 / 365.0 * (284 + yday))))
    h = F.radians(15.0 * (solar_hour - 12))
    s = F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(h)
    az = F.atan2(-F.sin(h) * F.cos(dec), F.cos(phi) * F.sin(dec) - F.sin(phi) * F.cos(dec) * F.cos(h))
    return F.struct(F.degrees(F.asin(clamp(s, -1, 1))).alias("elevation"), F.pmod(F.degrees(az), F.lit(360.0)).alias("azimuth"))


def erbs_diffuse(kt: Column) -> Column:
    """Diffuse share of global radiation by clearness index."""
    mid = 0.9511 - 0.1604 * kt + 4.388 * kt * kt - 16.638 * kt * kt * kt + 12.336 * kt * kt * kt * kt
    return F.when(kt <= 0.22, 1 - 0.09 * kt).when(kt <= 0.80, mid).otherwise(0.165)


def incidence_cosine(elevation: Column, azimuth: Column, tilt: Column, facing: Column) -> Column:
    e, t = F.radians(elevation), F.radians(tilt)
    return F.greatest(F.sin(e) * F.cos(t) + F.cos(e) * F.sin(t) * F.cos(F.radians(azimuth - facing)), F.lit(0.0))


def cell_temperature_factor(air_c: Column, poa_w: Column) -> Column:
    return clamp(1 - 0.004 * (air_c + poa_w / 800 * 20 - 25), 0.75, 1.08)


def sky_view(horizon_deg: Column) -> Column:
    """Mean of cos2 of the horizon angles around a site."""
    c = F.transform(horizon_deg, lambda h: F.pow(F.cos(F.radians(F.greatest(h, F.lit(0.0)))), F.lit(2.0)))
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)


def twilight(sun_elevation: Column) -> Column:
    e = sun_elevation
    return F.when(e >= 0, "day").when(e >= -6, "civil_twilight").when(e >= -12, "nautical_twilight").when(e >= -18, "astronomical_twilight").otherwise("night")


def horizon_at(profile: Column, azimuth: Column) -> Column:
    """A horizon profile (equal azimuth bins from north) between its two nearest bins, around the circle."""
    n = F.size(profile)
    at = F.pmod(azimuth, F.lit(360.0)) / 360.0 * n
    i = F.floor(at).cast("int")
    a, b = F.get(profile, i % n), F.get(profile, (i + 1) % n)
    return a + (b - a) * (at - i)


# Solar constant, ozone and water columns in cm, aerosol depth, ground albedo.
SOLAR_W, OZONE, WATER, AEROSOL, GROUND = 1367.0, 0.30, 1.50, 0.10, 0.20


def clear_sky(sun_elevation: Column, elevation_m: float, yday: Column) -> Column:
    """``struct<dni, dhi, ghi>``: direct, diffuse and global clear-sky irradiance in W/m2 by broadband transmittances, zero while
    the sun is down. Values used more than once are bound, which keeps the expression small."""
    power = lambda base, e: F.pow(base, F.lit(e))
    cosz = F.sin(F.radians(sun_elevation))
    top = SOLAR_W * (1 + 0.033 * F.cos(2 * math.pi * yday / 365))
    mass = math.exp(-max(0.0, elevation_m) / 8434.5) / (cosz + 0.50572 * power(F.greatest(96.07995 - (90 - sun_elevation), F.lit(1e-6)), -1.6364))

    def passed(v: Column) -> Column:
        m = v["mass"]
        uo, uw = OZONE * m, WATER * m
        ozone = 1 - 0.1611 * uo * power(1 + 139.48 * uo, -0.3035) - 0.002715 * uo / (1 + 0.044 * uo + 0.0003 * uo * uo)
        water = 1 - 2.4959 * uw / (power(1 + 79.034 * uw, 0.6828) + 6.385 * uw)
        rayleigh = F.exp(-0.0903 * power(m, 0.84) * (1 + m - power(m, 1.01)))
        haze = F.exp(-(AEROSOL**0.873) * (1 + AEROSOL - AEROSOL**0.7088) * power(m, 0.9108))
        return F.struct(v["cosz"].alias("cosz"), v["top"].alias("top"), (ozone * water).alias("gases"), F.exp(-0.0127 * power(m, 0.26)).alias("mixed"), rayleigh.alias("rayleigh"), haze.alias("haze"))

    def fluxes(v: Column) -> Column:
        direct = F.greatest(0.9662 * v["top"] * v["rayleigh"] * v["mixed"] * v["gases"] * v["haze"], F.lit(0.0))
        scattered = v["top"] * v["cosz"] * v["gases"] * v["mixed"]
        diffuse = F.greatest(scattered * (1 - v["rayleigh"]) * 0.5 + scattered * v["rayleigh"] * (1 - v["haze"]) * 0.75, F.lit(0.0))
        mirror = GROUND * (0.0685 + 0.16 * (1 - v["haze"]))
        return F.struct(direct.alias("dni"), (diffuse + (direct * v["cosz"] + diffuse) * mirror / (1 - mirror)).alias("dhi"), v["cosz"].alias("cosz"))

    found = bind(bind(bind(F.struct(cosz.alias("cosz"), top.alias("top"), mass.alias("mass")), passed), fluxes), lambda f: F.struct(f["dni"], f["dhi"], (f["dni"] * f["cosz"] + f["dhi"]).alias("ghi")))
    none = F.struct(*[F.lit(0.0).alias(n) for n in ("dni", "dhi", "ghi")])
    return F.when(cosz > 0, found).otherwise(none)


def belt_position(lat_deg: float | Column, offset_deg: Column) -> Column:
    """``struct<azimuth, elevation>`` of a geostationary satellite ``offset_deg`` of longitude away."""
    phi, far, near = F.radians(lat_deg if isinstance(lat_deg, Column) else F.lit(lat_deg)), 42164.0, 6371.0
    d = F.radians(offset_deg)
    x, y, z = far * F.cos(d) - near * F.cos(phi), far * F.sin(d), -near * F.sin(phi)
    north, up = -F.sin(phi) * x + F.cos(phi) * z, F.cos(phi) * x + F.sin(phi) * z
    return F.struct(F.pmod(F.degrees(F.atan2(y, north)), F.lit(360.0)).alias("azimuth"), F.degrees(F.atan2(up, F.hypot(y, north))).alias("elevation"))
