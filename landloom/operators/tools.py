"""Land queries as table functions for SQL, with their arguments checked.

``register(spark, entities, cells, grid)`` makes views and temporary functions of the session; ``select * from region_summary(0, 0, 500)`` then
plans like any other query. A refused argument fails the query with a JSON text that names the error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .raster import Grid

KINDS = ("customer", "supplier", "part")


def _checked(test: str, error: str, value: str) -> str:
    """SQL that is true where ``test`` holds and else refuses the query."""
    return f"""(case when {test} then true else raise_error(to_json(named_struct('error', '{error}', 'got', cast({value} as string)))) end)"""


def register(spark: SparkSession, entities: DataFrame, cells: DataFrame, grid: Grid) -> list[str]:
    """Registers ``find_entities(kind, x, y, r)``, ``region_summary(x, y, r)``, ``get_entity(id)`` and ``can_see(x, y, x2, y2)``; gives their names.

    ``entities`` has ``entity_id, kind, x, y``; ``cells`` has ``row, col, v`` on ``grid``. Points are scene metres, distances metres; eyes are at 1.7 m, targets at the ground.
    """
    entities.createOrReplaceTempView("tool_entities")
    cells.createOrReplaceTempView("tool_cells")
    near = lambda f: f"(e.x - {f}.x) * (e.x - {f}.x) + (e.y - {f}.y) * (e.y - {f}.y) <= {f}.r * {f}.r"
    far = lambda f: _checked(f"{f}.r > 0 and {f}.r <= 100000", "r has to be over 0 and at most 100000", f"{f}.r")
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    row, col = f"cast(floor(({grid.y0}d - s.y) / {grid.size}d) as bigint)", f"cast(floor((s.x - {grid.x0}d) / {grid.size}d) as bigint)"
    bodies = {
        "find_entities(kind string, x double, y double, r double) returns table (entity_id string, distance double)": f"""
            select e.entity_id, sqrt((e.x - find_entities.x) * (e.x - find_entities.x) + (e.y - find_entities.y) * (e.y - find_entities.y)) as distance from (select {far("find_entities")} and {_checked(f"find_entities.kind in ({kinds})", "unknown kind", "find_entities.kind")} as ok) k join tool_entities e
            on k.ok and e.kind = find_entities.kind and {near("find_entities")}""",
        "region_summary(x double, y double, r double) returns table (kind string, n bigint)": f"select e.kind, count(*) as n from (select {far('region_summary')} as ok) k join tool_entities e on k.ok and {near('region_summary')} group by e.kind",
        "get_entity(id string) returns table (entity_id string, kind string, x double, y double)": "select e.entity_id, e.kind, e.x, e.y from tool_entities e where e.entity_id = get_entity.id",
        "can_see(x double, y double, x2 double, y2 double) returns table (visible boolean, clearance double)": f"""
            with s as (select i / 200d as f, can_see.x + (can_see.x2 - can_see.x) * i / 200d as x, can_see.y + (can_see.y2 - can_see.y) * i / 200d as y from (select explode(sequence(0, 200)) as i)),
            t as (select s.f, c.v from s join tool_cells c on c.row = {row} and c.col = {col}),
            ends as (select max(case when f = 0 then v end) + 1.7d as a, max(case when f = 1 then v end) as b from t)
            select min(a + (b - a) * f - v) >= 0 as visible, min(a + (b - a) * f - v) as clearance from t, ends where f > 0 and f < 1""",
    }
    for head, body in bodies.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return [h.split("(")[0] for h in bodies]
