"""Plain-language sentences about a spot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The wording of each finding; %s stands for a measure.
TEXT = {
    "fuel": "Fuel here: %s.",
    "flat": "On a moderate day this fuel carries fire at ~%s on flat ground.",
    "flat_and_slope": "On a moderate day this fuel carries fire at ~%s on flat ground, ~%s with this slope.",
    "slope": "On a moderate day this slope-adjusted fuel carries fire at ~%s.",
    "late": "The fire never reaches this spot in this scenario (within its %s-minute window).",
    "arrival": "Fire reaches this spot ~%s after ignition (+/- class; one wind guess).",
    "flames": "~%s flames here.",
    "flames_and_intensity": "~%s flames here (~%s).",
    "intensity": "Fireline intensity is ~%s here.",
    "crown_0": "Modeled as a surface fire here under this scenario — the canopy is not predicted to ignite.",
    "crown_1": "Passive crown fire (torching) is modeled here under this scenario — individual trees or clumps candle.",
    "crown_2": "Active crown fire is modeled here under this scenario — fire carries through the canopy.",
    "embers": "This spot is in the downwind ember-exposure band; firebrands can cross water, wetlands, roads, and cleared gaps.",
}


def measure(value: Column, unit: str) -> Column:
    """One decimal below ten, none from there on."""
    return F.concat(F.when(F.abs(value) < 10, F.format_string("%.1f", value)).otherwise(F.bround(value).cast("long").cast("string")), F.lit(f" {unit}"))


def minutes(value: Column) -> Column:
    """Minutes below an hour and a half, hours from there on."""
    return F.when(value < 90, F.concat(F.bround(value).cast("long").cast("string"), F.lit(" min"))).otherwise(F.concat(F.format_string("%.1f", value / 60), F.lit(" hr")))


def fire_sentences(fuel: Column, flat_ros: Column, slope_ros: Column, arrival: Column, duration: Column, flame: Column, intensity: Column, crown: Column, ember: Column) -> Column:
    """The sentences that hold at a spot as an array; a null measure says nothing."""
    say = lambda key, *parts: F.format_string(TEXT[key], *parts) if parts else F.lit(TEXT[key])
    has = lambda c: c.isNotNull()
    flat, slope, height, power = measure(flat_ros, "m/min"), measure(slope_ros, "m/min"), measure(flame, "m"), measure(intensity, "kW/m")
    said = F.array(
        F.when(has(fuel), say("fuel", fuel)),
        F.when(has(flat_ros) & has(slope_ros), say("flat_and_slope", flat, slope)).when(has(flat_ros), say("flat", flat)).when(has(slope_ros), say("slope", slope)),
        F.when(arrival > duration, say("late", F.bround(duration).cast("long").cast("string"))).when(has(arrival), say("arrival", minutes(arrival))),
        F.when(has(flame) & has(intensity), say("flames_and_intensity", height, power)).when(has(flame), say("flames", height)).when(has(intensity), say("intensity", power)),
        F.when(crown == 0, say("crown_0")).when(crown == 1, say("crown_1")).when(crown == 2, say("crown_2")),
        F.when(has(ember), say("embers")),
    )
    return F.array_compact(said)
