"""Plan queries: edits from suppliers, trees from parts, on the synthetic terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import views as V
from landloom.operators.raster import Grid
from landloom.plans import edits as E

QUERIES, ORACLES = {}, {}
GRID = Grid(x0=-320.0, y0=320.0, size=10.0, width=64, height=64)
KINDS = ("terrain_cut", "terrain_fill", "vegetation_remove", "orchard")
FALL = ("hard", "linear", "smoothstep")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def edits(spark, d):
    k = F.col("s_suppkey").cast("long")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return V.table(spark, d, "supplier").select(
        F.concat(F.lit("e"), k.cast("string")).alias("edit_id"), k.alias("ordinal"), pick(KINDS, k).alias("kind"), (k * 37 % 600 - 300).cast("double").alias("x"),
        (k * 91 % 600 - 300).cast("double").alias("y"), (k % 9 * 10 + 20).cast("double").alias("r"), (k % 5 + 1).cast("double").alias("dz"), pick(FALL, k).alias("falloff"),
    )


def trees(spark, d):
    k = F.col("p_partkey").cast("long")
    return V.table(spark, d, "part").select(k.cast("string").alias("id"), (k * 53 % 640 - 320).cast("double").alias("x"), (k * 29 % 640 - 320).cast("double").alias("y"))


_ED = """ed as (select 'e' || s_suppkey as edit_id, s_suppkey::bigint as ordinal, ['terrain_cut','terrain_fill','vegetation_remove','orchard'][s_suppkey % 4 + 1] as kind, (s_suppkey * 37 % 600 - 300)::double as x,
  (s_suppkey * 91 % 600 - 300)::double as y, (s_suppkey % 9 * 10 + 20)::double as r, (s_suppkey % 5 + 1)::double as dz, ['hard','linear','smoothstep'][s_suppkey % 3 + 1] as falloff from supplier),
  trees as (select p_partkey::varchar as id, (p_partkey * 53 % 640 - 320)::double as x, (p_partkey * 29 % 640 - 320)::double as y from part)"""
_DELTA = (
    V.SQL["terrain"]
    + ", "
    + _ED
    + """, cl as (select id // 64 as row, id % 64 as col, -320 + (id % 64 + 0.5) * 10.0::double as px, 320 - (id // 64 + 0.5) * 10.0::double as py from (select row * 64 + col as id from terrain)),
  part_dz as (select row, col, case kind when 'terrain_cut' then -dz else dz end * case when falloff = 'hard' then 1 when falloff = 'linear' then 1 - dd/r else (1-dd/r)*(1-dd/r)*(3-2*(1-dd/r)) end as v
    from (select *, sqrt((px-x)*(px-x)+(py-y)*(py-y)) as dd from cl, ed where kind in ('terrain_cut', 'terrain_fill')) where dd <= r),
  delta as (select row, col, least(greatest(sum(v), -30), 30) as dz from part_dz group by 1, 2),
  gone as (select t.id, arg_min(e.edit_id, e.ordinal) as edit_id from trees t, ed e where e.kind = 'vegetation_remove' and (t.x-e.x)*(t.x-e.x)+(t.y-e.y)*(t.y-e.y) <= e.r*e.r group by 1)"""
)
_PLANT = """, lat as (select edit_id, x, y, r, i, j from ed, range(-20, 21) a(i), range(-20, 21) b(j) where kind = 'orchard' and abs(i) <= ceil(r/8) and abs(j) <= ceil(r/8)),
  jit as (select *, x + i*8 + ((('0x' || substr(sha1(edit_id || '|' || i || '|' || j || '|x'), 1, 12))::hugeint / 281474976710655.0) - 0.5) * 4 as px,
     y + j*8 + ((('0x' || substr(sha1(edit_id || '|' || i || '|' || j || '|y'), 1, 12))::hugeint / 281474976710655.0) - 0.5) * 4 as py from lat),
  plants as (select edit_id || ':' || i || ':' || j as id, edit_id, round(px, 3) as x, round(py, 3) as y from jit where (px-x)*(px-x)+(py-y)*(py-y) <= r*r)"""


@query(f"with {_DELTA} select row, col, round(dz, 6) as dz from delta")
def h26_terrain_delta(spark, d):
    cells = V.terrain(spark, d).select("row", "col")
    return E.terrain_delta(cells, edits(spark, d), GRID).select("row", "col", F.round("dz", 6).alias("dz"))


@query(f"with {_DELTA} select id, edit_id from gone")
def c21_vegetation_removal(spark, d):
    return E.removals(trees(spark, d), edits(spark, d))


@query(f"with {_DELTA}{_PLANT} select id, edit_id, x, y from plants")
def h28_orchard_plantings(spark, d):
    return E.plantings(edits(spark, d), 8.0)


@query(f"with {_DELTA}{_PLANT} select id, x, y from trees where id not in (select id from gone) union all select id, x, y from plants")
def c22_effective_vegetation(spark, d):
    e = edits(spark, d)
    return E.effective_vegetation(trees(spark, d), E.removals(trees(spark, d), e), E.plantings(e, 8.0))


@query(
    f"""with {_DELTA}{_PLANT} select round(coalesce(sum(-dz) filter (where dz < 0), 0) * 100, 3) as cut_m3, round(coalesce(sum(dz) filter (where dz > 0), 0) * 100, 3) as fill_m3, round(sum(dz) * 100, 3) as net_m3,
  (count(*) filter (where abs(dz) > 0.01) * 100)::double as disturbed_m2, round(max(abs(dz)), 6) as max_dz, count(*) filter (where abs(dz) >= 30) as clipped, (select count(*) from gone) as removed, (select count(*) from plants) as added from delta"""
)
def e21_plan_quantities(spark, d):
    e = edits(spark, d)
    q = E.quantities(E.terrain_delta(V.terrain(spark, d).select("row", "col"), e, GRID), E.removals(trees(spark, d), e), E.plantings(e, 8.0), 100.0)
    return q.select(*[F.round(c, 3).alias(c) for c in ("cut_m3", "fill_m3", "net_m3")], "disturbed_m2", F.round("max_dz", 6).alias("max_dz"), "clipped", "removed", "added")


@query(f"with {_ED} select kind, count(*) as n, sum(dz) as dz from ed group by 1")
def e22_proposal_preview(spark, d):
    return edits(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum("dz").alias("dz"))


@query("select o_orderkey, ('0x' || substr(sha1('part|' || o_orderkey), 1, 12))::hugeint / 281474976710655.0::double as u from orders")
def g04_hash_unit(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", E.unit(F.lit("part"), F.col("o_orderkey")).alias("u"))


@query("select c_custkey, 'customer:' || substr(sha1(c_name || '|' || c_custkey), 1, 12) as entity_id from customer")
def g02_entity_id(spark, d):
    h = F.substring(F.sha1(F.concat_ws("|", "c_name", F.col("c_custkey").cast("string"))), 1, 12)
    return V.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("customer:"), h).alias("entity_id"))
