"""Registered queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from . import fuel, geometry, ground, hydro, ingest, land, layers, live, places, plan, process, scenario, tools, water, weather, wildfire

MODULES = (land, ground, weather, live, plan, scenario, layers, process, places, fuel, water, hydro, geometry, ingest, wildfire, tools)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
