"""Radio packets as events: projections over VARIANT that stand drift of names and types, without Python.

A packet is JSON text. Senders write a field in snake or camel case, numbers as text, coordinates in degrees or in ten-millionths; what cannot
be read as its kind is null and fails nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions.geo import bind

#: Fields of an event by the kind that shows them; None: all kinds.
SHOWN = (("position", ("lat", "lon", "altitude", "speed", "heading")), ("status", ("label", "battery")), ("message", ("message",)), (None, ("snr", "rssi", "hops", "port")))


def _number(packet: Column, *paths: str) -> Column:
    """The first of several paths that holds a finite number, also one written as text."""
    found = [F.coalesce(F.try_variant_get(packet, p, "double"), F.try_variant_get(packet, p, "string").try_cast("double")) for p in paths]
    return F.coalesce(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in found])


def _text(packet: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(packet, p, "string")), F.lit("")) for p in paths])


def node_id(*candidates: Column) -> Column:
    """``!`` and eight hex digits of the first candidate that is a number or such an id, else the first text, else ``unknown``."""
    hexed = lambda n: F.concat(F.lit("!"), F.lower(F.lpad(F.hex(n.bitwiseAND(F.lit(2**32 - 1))), 8, "0")))
    marked = lambda c: F.when(F.lower(c).rlike("^!([0-9a-f]{1,8})$"), F.conv(F.substr(c, F.lit(2)), 16, 10).cast("long"))
    numbers = [hexed(F.coalesce(marked(c), F.when(c.rlike(r"^\d{1,10}$"), c.try_cast("long")))) for c in candidates]
    return F.coalesce(*numbers, *candidates, F.lit("unknown"))


def events(packets: DataFrame, gateway: str | None = None) -> DataFrame:
    """Events of packets (``id, packet`` as JSON text), one row each: ``id, device_id, kind, observed_ms, lat, lon, altitude, speed, heading, label, message,
    battery, snr, rssi, hops, port``.

    A position, a user's name, a text or readings make an event ``position``, ``status``, ``message`` or ``status``, in that order; other content is ``data``.
    Packets of the gateway itself, without content, of routing and administration, and what is no JSON object make none.
    """
    p = F.col("p")
    at = "$.decoded"
    coordinate = lambda n: F.coalesce(_number(p, f"{at}.position.{n}"), _number(p, f"{at}.position.{n}_i", f"{at}.position.{n}I") / 1e7)
    heading = _number(p, f"{at}.position.ground_track", f"{at}.position.groundTrack")
    turned = F.when(heading.between(0, 360), heading).when(heading.between(100_000, 36_000_000) & (heading == F.floor(heading)), heading / 100_000)
    start, limit = _number(p, "$.hopStart", "$.hop_start"), _number(p, "$.hopLimit", "$.hop_limit")
    time = _number(p, "$.rxTime")
    fields = {
        "device_id": node_id(_text(p, "$.fromId"), _text(p, "$.from")), "observed_ms": F.when(time > 0, F.floor(time) * 1000).cast("long"), "lat": coordinate("latitude"), "lon": coordinate("longitude"),
        "altitude": _number(p, f"{at}.position.altitude"), "speed": _number(p, f"{at}.position.ground_speed", f"{at}.position.groundSpeed"), "heading": turned,
        "label": _text(p, f"{at}.user.long_name", f"{at}.user.longName", f"{at}.user.id"), "message": _text(p, f"{at}.text"), "battery": _number(p, f"{at}.telemetry.device_metrics.battery_level", f"{at}.telemetry.deviceMetrics.batteryLevel"),
        "readings": F.try_variant_get(p, f"{at}.telemetry", "variant").isNotNull(), "snr": _number(p, "$.rxSnr"), "rssi": _number(p, "$.rxRssi"), "hops": F.when(start.isNotNull() & limit.isNotNull(), F.greatest(start - limit, F.lit(0.0))),
        "port": _text(p, f"{at}.portnum"), "content": F.try_variant_get(p, at, "variant").isNotNull(),
    }

    def event(c: Column) -> Column:
        quiet = F.coalesce(c["port"].isin("ROUTING_APP", "ADMIN_APP"), F.lit(False))
        kind = F.when(c["lat"].isNotNull() & c["lon"].isNotNull(), "position").when(c["label"].isNotNull(), "status").when(c["message"].isNotNull(), "message").when(c["readings"], "status").when(c["content"] & ~quiet, "data")
        return bind(kind, lambda k: F.struct(c["device_id"].alias("device_id"), k.alias("kind"), c["observed_ms"].alias("observed_ms"), *[
            (F.when(k == of, c[n]) if of else c[n]).alias(n) for of, names in SHOWN for n in names
        ]))

    # each packet is read once, and its event comes out of an array: filters on it are not pushed into the reading
    raw = packets.select("id", F.try_parse_json("packet").alias("p"))
    made = F.array(bind(F.struct(*[c.alias(n) for n, c in fields.items()]), event))
    sound = lambda e: e["kind"].isNotNull() & ((e["device_id"] != gateway) if gateway else F.lit(True))
    return raw.select("id", F.explode(F.filter(made, sound)).alias("e")).select("id", "e.*")
