"""Names, units and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def device_key(device_id: Column) -> Column:
    """A device id safe as a key: runs of other characters become one underscore, 120 characters at most."""
    return F.substring(F.regexp_replace(F.coalesce(device_id, F.lit("")), r"[^a-zA-Z0-9_.:!@-]+", "_"), 1, 120)


def node_id(value: Column) -> Column:
    """A radio node's id as ``!`` and eight hex digits, from ``!hex``, ``0xhex``, decimal or bare hex with a letter in it; other
    texts stay, blank ones are "unknown"."""
    t = F.trim(value)
    digits = F.when(t.rlike(r"^(!|0x)[0-9a-fA-F]{1,8}$"), F.conv(F.regexp_replace(t, "^(!|0x)", ""), 16, 10))
    digits = digits.when(t.rlike("^[0-9]+$"), t).when(t.rlike("^[0-9a-fA-F]{1,8}$"), F.conv(t, 16, 10))
    number = digits.try_cast("long")
    return F.when(number.between(0, 2**32 - 1), F.concat(F.lit("!"), F.lpad(F.lower(F.hex(number)), 8, "0"))).when(F.length(t) > 0, t).otherwise("unknown")


def utc_millis(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO time cut to seconds; null without an explicit zone or where it is no time."""
    t = F.trim(text)
    return F.when(t.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.unix_millis(F.date_trunc("second", F.try_to_timestamp(t))))


def flow_hectares(value: Column, unit: Column, cell_m2: Column) -> Column:
    """Contributing area in hectares from a value in ha, m2 or cells; null in any other unit or where cells have no area."""
    u = F.lower(F.trim(unit))
    area = F.when(cell_m2 > 0, cell_m2)
    return (
        F.when(u.isin("ha", "hectare", "hectares"), value).when(u.isin("m2", "sq_m", "sqm", "square_meter", "square_meters"), value / 10000)
        .when(u.isin("cell", "cells", "grid_cell", "grid_cells"), value * area / 10000)
    )


def download_class(size: Column) -> Column:
    return F.when(size.isNull(), "unknown").when(size < 100_000_000, "light").when(size < 1_000_000_000, "medium").otherwise("heavy")


def angle_between(a: Column, b: Column) -> Column:
    """Signed difference of two angles in degrees, in -180 to 180."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


#: Properties of map features that readers are never shown.
HIDDEN = ("__label", "OBJECTID", "Shape_Length", "Shape_Area", "Shape__Area", "Shape__Length", "SHAPE.AREA", "SHAPE.LEN", "SPATIALVER", "GlobalID")


def visible_properties(properties: Column) -> Column:
    """A map of properties without hidden and empty ones."""
    return F.map_filter(properties, lambda k, v: ~k.isin(*HIDDEN) & v.isNotNull() & ~v.isin("", " "))


def color_ramp(t: Column, stops: list[tuple[int, int, int, int]]) -> Column:
    """The colour at ``t`` (cut to 0 to 1) between evenly spaced stops, as four whole numbers cut towards zero."""
    x = F.greatest(F.least(t, F.lit(0.999999)), F.lit(0.0)) * (len(stops) - 1)
    at = F.floor(x).cast("int")
    table = F.array(*[F.array(*[F.lit(float(v)) for v in stop]) for stop in stops])
    low, high = F.element_at(table, at + 1), F.element_at(table, at + 2)
    return F.transform(F.arrays_zip(low.alias("a"), high.alias("b")), lambda p: (p["a"] + (p["b"] - p["a"]) * (x - at)).cast("int"))
