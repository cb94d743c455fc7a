"""Geometry that is constructed: overlays, buffers, outlines of rasters, hulls, distance fields.

Outlines are tables of directed edges with the inside on their left. An overlay cuts the edges of all parts of a group where they cross
and keeps the pieces that the operation asks for; an outline of a raster is the sides between unlike cells. Both are linked
into rings by list ranking: every edge knows the next one, and pointer doubling gives the ring's name and each edge's place, so that
a ring of any length never meets in one task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions import geo
from landloom.session import checkpointed

from .raster import roots
from .spatial import cell, dealt, touched

#: Points nearer than this are one point.
TOUCH = 1e-7


# --- rings ---------------------------------------------------------------------------------------------


def _key(v: Column) -> Column:
    return F.round(v / TOUCH / 8).cast("long")


#: About so many edges of a tile are chained in one task, before chains of all tiles are linked.
TILE = 100_000


def _chained(edges: pa.Table) -> pa.Table:
    """Edges of a tile (``id, to``) with their ``chain``, named by its first edge, and place in it. A ring inside the tile begins at its smallest edge and is ``closed``.

    At place 0 stand the chain's ``size``, the edge it goes on with (``out``), its ``least`` edge and the place of that (``first``).
    """
    ids, to = edges["id"].to_numpy(), edges["to"].to_numpy()
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids[order], to), len(ids) - 1)
    next_ = np.where(ids[order][at] == to, order[at], -1)
    headed = np.ones(len(ids), bool)
    headed[next_[next_ >= 0]] = False
    steps, seen = next_.tolist(), bytearray(len(ids))
    chain, off = [0] * len(ids), [0] * len(ids)
    closed, size, least, first, out = np.zeros(len(ids), bool), *np.zeros((4, len(ids)), np.int64)
    number, goal = ids.tolist(), to.tolist()
    # chains that come from elsewhere first; what is then left are rings, met at their smallest edge
    for start in [*np.flatnonzero(headed).tolist(), *order.tolist()]:
        if seen[start]:
            continue
        k, n, low, low_at = start, 0, number[start], 0
        while k >= 0 and not seen[k]:
            seen[k], chain[k], off[k] = 1, start, n
            if number[k] < low:
                low, low_at = number[k], n
            last, k, n = k, steps[k], n + 1
        closed[start] = k == start
        size[start], least[start], first[start], out[start] = n, low, low_at, goal[last]
    head = np.array(chain)
    columns = {"closed": closed[head], "chain": ids[head], "off": np.array(off, np.int64), "size": size, "out": out, "least": least, "first": first}
    return pa.table({"group": edges["group"], "x": edges["x1"], "y": edges["y1"], "x2": edges["x2"], "y2": edges["y2"], **columns})


def rings(edges: DataFrame) -> DataFrame:
    """``group, ring, seq, x, y, x2, y2``: the corners of all rings that directed edges (``group, x1, y1, x2, y2``) form, from 0, without the closing one, each with the one after it.

    An edge goes on with the one that starts where it ends; of several, with the one furthest to the left, so that rings touch in
    points but do not cross. ``ring`` is the smallest number of its edges. Edges have to form closed rings. Edges of a large group are chained by tile first,
    those of other groups by group, many groups to a task.
    """
    e = edges.select("group", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    numbered = e.withColumn("id", F.monotonically_increasing_id())
    e = checkpointed(numbered.withColumns({"sx": _key(F.col("x1")), "sy": _key(F.col("y1")), "ex": _key(F.col("x2")), "ey": _key(F.col("y2"))}))
    after = e.select("group", F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("id").alias("to"), F.col("x1").alias("ux"), F.col("y1").alias("uy"), F.col("x2").alias("vx"), F.col("y2").alias("vy"))
    dx, dy, ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
    turn = F.atan2(dx * uy - dy * ux, dx * ux + dy * uy)
    # grouped by the keys of the join and more: nothing moves again
    next_ = e.join(dealt(after), ["group", "ex", "ey"]).groupBy("group", "ex", "ey", "id", "x1", "y1").agg(F.max(F.struct(turn.alias("turn"), (-F.col("to")).alias("m"), "ux", "uy")).alias("b"))
    members = next_.select("id", (-F.col("b.m")).alias("to"), "group", "x1", "y1", F.col("b.ux").alias("x2"), F.col("b.uy").alias("y2"))
    at = e.agg(F.count("*"), F.min("x1"), F.max("x1"), F.min("y1"), F.max("y1")).first()
    tiles, w, h = -(-at[0] // TILE) or 1, *((at[2] - at[1], at[4] - at[3]) if at[0] else (0.0, 0.0))
    side = max(math.sqrt(w * h / tiles), w / tiles, h / tiles, 1e-3)
    # at most one group in TILE edges is large
    large = e.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("group", F.lit(True).alias("large"))
    hashed = lambda n: F.pmod(F.xxhash64("group"), F.lit(n).cast("long"))
    tile = [F.when(F.col("large"), cell(F.col("x1"), side)).otherwise(hashed(tiles * 16)).alias("cx"), F.when(F.col("large"), cell(F.col("y1"), side)).alias("cy"), F.when(F.col("large"), hashed(16)).alias("salt")]
    members = members.join(F.broadcast(large), "group", "left").select("id", "to", "group", "x1", "y1", "x2", "y2", *tile)
    kind = members.select("group", *[F.col(f"{c}1").alias(c) for c in "xy"], "x2", "y2", F.lit(True).alias("closed"), *[F.lit(0).cast("long").alias(n) for n in ("chain", "off", "size", "out", "least", "first")]).schema
    members = checkpointed(members.groupBy("cx", "cy", "salt").applyInArrow(_chained, kind))
    closed = members.where("closed").select("group", F.col("chain").alias("ring"), F.col("off").alias("seq"), "x", "y", "x2", "y2")
    heads = checkpointed(members.where("not closed and off = 0").select(F.col("chain").alias("c"), F.col("out").alias("t"), "size", "least", "first"))
    if heads.isEmpty():
        return closed
    # of the chains that go on in other tiles: the smallest number among the next 2^k, until nothing gets smaller
    least = heads.select("c", "t", F.col("least").alias("ring"))
    while True:
        ahead = least.select(F.col("c").alias("t"), F.col("t").alias("t2"), F.col("ring").alias("other"))
        least = checkpointed(least.join(ahead, "t").select("c", F.col("t2").alias("t"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("fell")))
        if least.where("fell").isEmpty():
            break
        least = least.drop("fell")
    named = checkpointed(heads.join(dealt(least.select("c", "ring")), "c"))
    # a ring is opened before the chain with its smallest edge; what is left to the last chain gives each one's place
    begin = named.where("least = ring").select("ring", F.col("c").alias("begin"))
    open_ = named.join(dealt(begin), "ring").where("t <> begin").select("c", "t", F.col("size").alias("steps"))
    placed = named.join(dealt(roots(open_).select("c", "steps")), "c", "left").withColumn("steps", F.coalesce("steps", F.lit(0)))
    here = F.col("least") == F.col("ring")
    whole = placed.groupBy("ring").agg(F.sum("size").alias("n"), F.max(F.when(here, F.col("steps"))).alias("all"), F.max(F.when(here, F.col("first"))).alias("start"))
    placed = placed.join(dealt(whole), "ring").select(F.col("c").alias("chain"), "ring", "n", (F.col("all") - F.col("steps") - F.col("start")).alias("from"))
    open_ = members.where("not closed").join(dealt(placed), "chain")
    open_ = open_.select("group", "ring", F.pmod(F.col("from") + F.col("off"), F.col("n")).alias("seq"), "x", "y", "x2", "y2")
    return checkpointed(closed.union(open_))


def ring_areas(corners: DataFrame) -> DataFrame:
    """``group, ring, area, corners``: signed areas of ``rings``; a hole's is negative."""
    first = corners.where("seq = 0").select("group", "ring", F.col("x").alias("x0"), F.col("y").alias("y0"))
    # cross products about the first corner: the edges at it add nothing
    both = corners.join(dealt(first), ["group", "ring"])
    cross = (F.col("x") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y") - F.col("y0"))
    return both.groupBy("group", "ring").agg((F.sum(cross) / 2).alias("area"), F.count("*").alias("corners"))


def polygonise(cells: DataFrame, grid) -> DataFrame:
    """``group, ring, seq, x, y, x2, y2``: outlines of the regions of equal ``v`` (the ``group``) of a raster, holes clockwise.

    Cells that only touch at a corner are not joined. Cells with a null ``v`` have no outline.
    """
    have = cells.where("v is not null").select("row", "col", "v")
    # of the four sides with the cell on the left: cell across, start and end as corner numbers
    sides = [(1, 0, (0, 1), (1, 1)), (0, 1, (1, 1), (1, 0)), (-1, 0, (1, 0), (0, 0)), (0, -1, (0, 0), (0, 1))]
    side = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(("dr", "dc", "c1", "r1", "c2", "r2"), (dr, dc, *a, *b))]) for dr, dc, a, b in sides]))
    want = have.withColumn("s", side).select("row", "col", "v", (F.col("row") + F.col("s.dr")).alias("r"), (F.col("col") + F.col("s.dc")).alias("c"), "s")
    across = have.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("v").alias("other"))
    outer = want.join(across, ["r", "c"], "left").where("other is null or other <> v")
    x = lambda n: grid.x0 + (F.col("col") + F.col(f"s.c{n}")) * grid.size
    y = lambda n: grid.y0 - (F.col("row") + F.col(f"s.r{n}")) * grid.size
    return rings(outer.select(F.col("v").alias("group"), x(1).alias("x1"), y(1).alias("y1"), x(2).alias("x2"), y(2).alias("y2")))


# --- overlays ------------------------------------------------------------------------------------------


def _left_handed(ring: Column) -> Column:
    """The ring with its inside on the left."""
    cross = F.transform(geo.edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) < 0, F.reverse(ring)).otherwise(ring)


def _sides(ring: Column) -> Column:
    """Edges of a ring as flat structs: walked for many points, they are not to be made anew for each."""
    return F.transform(geo.edges(ring), lambda e: F.struct(*[e[p][c].alias(p_c) for p, c, p_c in (("a", "x", "ax"), ("a", "y", "ay"), ("b", "x", "bx"), ("b", "y", "by"))]))


def _within(x: Column, y: Column, sides: Column) -> Column:
    """``geo.in_ring`` by ``_sides``."""

    def crossed(e: Column) -> Column:
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
        return ((e["by"] > y) != (e["ay"] > y)) & (x < at)

    return F.size(F.filter(sides, crossed)) % 2 == 1


def _shared(whole: DataFrame, edge: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Cells of ``size`` that several parts of a group hold: the parts in them (``group, part, cx, cy``), and the cells (``group, cx, cy``). Elsewhere parts do not meet.

    A part holds the cells that its edges touch, and those between two of them in a row of cells that are inside its ring: one is tested for all of a gap.
    """
    row = Window.partitionBy("group", "part", "cy").orderBy("cx")
    rim = touched(edge, size).select("group", "part", "cx", "cy").withColumn("next", F.lead("cx").over(row)).where("next is null or next > cx")
    rim = checkpointed(rim)
    px, py = (F.col("cx") + 1.5) * size, (F.col("cy") + 0.5) * size
    gaps = rim.where("next > cx + 1").join(dealt(whole), ["group", "part"]).where(_within(px, py, F.col("sides")))
    filled = gaps.select("group", "part", F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"), "cy")
    many = F.count("*").over(Window.partitionBy("group", "cx", "cy"))
    held = checkpointed(rim.drop("next").unionByName(filled).withColumn("many", many).where("many > 1").drop("many"))
    return held, held.select("group", "cx", "cy").distinct()


def overlay(parts: DataFrame, how: str, size: float = 100.0) -> DataFrame:
    """``group, ring, seq, x, y, x2, y2``: the union or the intersection of all parts (``group, part, ring``, one closed ring each) of every group.

    Edges meet the edges of other parts that share a cell of ``size`` with them and are cut there; a piece stays if its middle is outside
    all other parts (union) or inside all of them (intersection). Of pieces that coincide the smallest part's stays if they run the same way, else none.
    Holes of the result run clockwise. An empty result has no rows. Parts without an area are left out.
    """
    # equal parts are one; dealt before the work on their corners, of which the bytes tell little
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = checkpointed(parts.groupBy("group", "ring").agg(F.min(F.col("part").cast("long")).alias("part")).repartition(n, "group", "part"))
    whole = whole.where(geo.shoelace(F.col("ring")) > 0).select("group", "part", _left_handed(F.col("ring")).alias("ring"))
    whole = checkpointed(checkpointed(whole).select("group", "part", _sides(F.col("ring")).alias("sides"), geo.bbox(F.col("ring")).alias("box")))
    edge = whole.select("group", "part", F.posexplode("sides").alias("i", "e")).select("group", "part", "i", F.col("e.ax").alias("x1"), F.col("e.ay").alias("y1"), F.col("e.bx").alias("x2"), F.col("e.by").alias("y2"))
    edge = checkpointed(edge.where("x1 <> x2 or y1 <> y2"))
    held, cells = _shared(whole, edge, size)
    place = ["group", "cx", "cy"]
    near = checkpointed(touched(edge, size).join(dealt(cells), place, "left_semi"))
    other = near.select("group", "cx", "cy", *[F.col(c).alias("o" + c) for c in ("part", "x1", "y1", "x2", "y2")])
    dx, dy, ox, oy = (F.col(b) - F.col(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("ox1", "ox2"), ("oy1", "oy2")))
    length = F.hypot(dx, dy)
    cross, wx, wy = dx * oy - dy * ox, F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    t, u = (wx * oy - wy * ox) / F.nullif(cross, F.lit(0.0)), (wx * dy - wy * dx) / F.nullif(cross, F.lit(0.0))
    at = lambda px, py: ((F.col(px) - F.col("x1")) * dx + (F.col(py) - F.col("y1")) * dy) / (length * length)
    off = lambda px, py: F.abs((F.col(px) - F.col("x1")) * dy - (F.col(py) - F.col("y1")) * dx) / length
    slack = TOUCH / F.hypot(ox, oy)
    crossing = F.when((F.abs(cross) > 1e-12 * length * F.hypot(ox, oy)) & u.between(-slack, 1 + slack), t)
    # an end of the other edge that lies on this one cuts it, too, also where both run along each other
    cuts = F.array(crossing, F.when(off("ox1", "oy1") < TOUCH, at("ox1", "oy1")), F.when(off("ox2", "oy2") < TOUCH, at("ox2", "oy2")))
    inner = lambda t: (t > TOUCH / length) & (t < 1 - TOUCH / length)
    key = ["group", "part", "i"]
    # what cuts an edge lies within TOUCH of both: their boxes meet, and neither is off the other's line on one side
    lo, hi = (lambda c, o="": F.least(f"{o}{c}1", f"{o}{c}2")), (lambda c, o="": F.greatest(f"{o}{c}1", f"{o}{c}2"))
    meet = [(lo(c) <= hi(c, "o") + 2 * TOUCH) & (lo(c, "o") <= hi(c) + 2 * TOUCH) for c in "xy"]
    for one, other_ in (("", "o"), ("o", "")):
        rx, ry = (F.col(f"{one}{c}2") - F.col(f"{one}{c}1") for c in "xy")
        ends = [rx * (F.col(f"{other_}y{n}") - F.col(f"{one}y1")) - ry * (F.col(f"{other_}x{n}") - F.col(f"{one}x1")) for n in (1, 2)]
        wide = 2 * TOUCH * (F.abs(rx) + F.abs(ry))
        meet += [(F.least(*ends) <= wide) & (F.greatest(*ends) >= -wide)]
    cut = near.join(dealt(other), place).where("part <> opart").where(reduce(Column.__and__, meet)).select(*key, "x1", "y1", "x2", "y2", F.explode(cuts).alias("t"))
    cut = cut.where(inner(F.col("t"))).groupBy(*key).agg(F.sort_array(F.collect_set("t")).alias("ts"))
    ends = edge.join(dealt(cut), key, "left").withColumn("ts", F.when(F.col("ts").isNotNull(), F.concat(F.array(F.lit(0.0)), "ts", F.array(F.lit(1.0)))))
    between = F.zip_with(F.slice("ts", F.lit(1), F.size("ts") - 1), F.slice("ts", F.lit(2), F.size("ts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # most edges are one piece
    pair = F.explode(F.when(F.col("ts").isNull(), F.array(F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")))).otherwise(between))
    on = lambda c, s: F.when(F.col(s) == 0, F.col(f"{c}1")).when(F.col(s) == 1, F.col(f"{c}2")).otherwise(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col(s))
    piece = ends.withColumn("s", pair).where((F.col("s.b") - F.col("s.a")) * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > TOUCH)
    piece = piece.select(*key, F.col("s.a").alias("from"), *[on(c, f"s.{s}").alias(f"{c}{n}") for c in "xy" for n, s in ((1, "a"), (2, "b"))])
    piece = checkpointed(piece.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2}))
    # which other parts hold a piece, and which it runs along
    mid = piece.withColumn("cx", cell(F.col("mx"), size)).withColumn("cy", cell(F.col("my"), size))
    one = [*key, "from"]
    along = mid.join(dealt(other.withColumnsRenamed({"opart": "q"})), place).where("part <> q")
    ex, ey = F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    span = F.hypot(ex, ey)
    beside = [F.col(f"m{c}").between(lo(c, "o") - 2 * TOUCH, hi(c, "o") + 2 * TOUCH) for c in "xy"]
    lies = (F.abs((F.col("mx") - F.col("ox1")) * ey - (F.col("my") - F.col("oy1")) * ex) / span < TOUCH) & (((F.col("mx") - F.col("ox1")) * ex + (F.col("my") - F.col("oy1")) * ey) / (span * span)).between(0.0, 1.0)
    same = (F.col("x2") - F.col("x1")) * ex + (F.col("y2") - F.col("y1")) * ey > 0
    along = along.where(beside[0] & beside[1]).where(lies).select(*one, "q", F.lit(False).alias("inside"), F.lit(True).alias("along"), same.alias("same"))
    # a part is asked with its ring only for pieces in cells that it holds and under its box
    boxed = held.join(dealt(whole.select("group", "part", "box.*")), ["group", "part"]).withColumnRenamed("part", "q")
    under = F.col("mx").between(F.col("min_x"), F.col("max_x")) & F.col("my").between(F.col("min_y"), F.col("max_y"))
    asked = mid.select(*one, "mx", "my", *place[1:]).join(dealt(boxed), place).where("part <> q").where(under).select(*one, "mx", "my", "q").repartition(n, "group", "q")
    inside = asked.join(dealt(whole.select("group", F.col("part").alias("q"), "sides")), ["group", "q"]).where(_within(F.col("mx"), F.col("my"), F.col("sides")))
    inside = inside.select(*one, "q", F.lit(True).alias("inside"), F.lit(False).alias("along"), F.lit(False).alias("same"))
    # dealt by piece once, for both counts and the join
    found = inside.union(along).repartition(n, *one).groupBy(*one, "q").agg(*[F.max(c).alias(c) for c in ("inside", "along", "same")])
    found = found.groupBy(*one).agg(F.count_if(F.col("inside") & ~F.col("along")).alias("inside"), F.count_if("along").alias("beside"), F.count_if(F.col("same") & (F.col("part") < F.col("q"))).alias("owned"))
    known = piece.join(dealt(found), one, "left").fillna(0, ["inside", "beside", "owned"]).where("beside = owned")
    if how == "intersection":
        count = whole.groupBy("group").agg(F.count_distinct("part").alias("parts"))
        known = known.join(count, "group").where("inside + beside = parts - 1")
    elif how == "union":
        known = known.where("inside = 0")
    else:
        raise ValueError("an overlay is a union or an intersection")
    return rings(known.select("group", "x1", "y1", "x2", "y2"))


def buffer(paths: DataFrame, path_id: str, r: float, quarter: int = 6, path: str = "path", size: float | None = None) -> DataFrame:
    """``group, ring, seq, x, y, x2, y2``: the outline at a distance ``r`` around every polyline, round ends and joints as polygons of ``quarter`` corners a quarter turn.

    The union of one capsule a segment. A path of one point gives a disc.
    """
    step = math.pi / 2 / quarter

    def capsule(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        # all corners have the directions of one fixed fan, so that discs at a common joint coincide
        turn = F.floor(F.atan2(dy, dx) / step + 0.5).cast("int")
        fan = lambda p, lo, hi: F.transform(F.sequence(turn + lo, turn + hi), lambda k: F.struct((p["x"] + r * F.cos(k * step)).alias("x"), (p["y"] + r * F.sin(k * step)).alias("y")))
        ring = F.concat(fan(e["b"], -quarter, quarter), fan(e["a"], quarter, 3 * quarter))
        return F.concat(ring, F.slice(ring, 1, 1))

    lone = F.array(F.struct(F.get(F.col(path), F.lit(0)).alias("a"), F.get(F.col(path), F.lit(0)).alias("b")))
    steps = F.when(F.size(path) > 1, geo.edges(F.col(path))).otherwise(lone)
    # a small file of paths is one task: they are dealt before capsules are made
    paths = paths.select(path_id, path).repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), path_id)
    parts = paths.where(F.size(path) > 0).select(F.col(path_id).alias("group"), F.posexplode(steps).alias("part", "e")).select("group", "part", capsule(F.col("e")).alias("ring"))
    return overlay(parts, "union", size or max(4 * r, 50.0))


# --- hulls ---------------------------------------------------------------------------------------------


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise from the smallest; points on its sides are left out."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p.tolist())[:-1] + chain(p[::-1].tolist())[:-1])


def _rectangle(h: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre, long and short side and direction of the long one (degrees, 0 to 180) of the least rectangle around a hull: one side lies on an edge."""
    if len(h) < 2:
        return (*(h[0] if len(h) else (0.0, 0.0)), 0.0, 0.0, 0.0)
    d = np.roll(h, -1, 0) - h if len(h) > 2 else h[1:] - h[:1]
    u = d / np.hypot(*d.T)[:, None]
    v = np.stack([-u[:, 1], u[:, 0]], 1)
    a, b = u @ h.T, v @ h.T
    wide, high = np.ptp(a, 1), np.ptp(b, 1)
    k = int(np.argmin(np.round(wide * high, 9)))
    ca, cb = (a[k].min() + a[k].max()) / 2, (b[k].min() + b[k].max()) / 2
    along = u[k] if wide[k] >= high[k] else v[k]
    return (*(ca * u[k] + cb * v[k]), max(wide[k], high[k]), min(wide[k], high[k]), math.degrees(math.atan2(along[1], along[0])) % 180)


def footprints(points: DataFrame, group: str) -> DataFrame:
    """``group, corners, area, cx, cy, long, short, angle``: hull and least rectangle of the points (``x, y``) of each group.

    Hulls are merged: tasks keep only the corners of their rows' hulls, then the corners of a group's partial hulls, first in a few salted
    parts, give the hull. What meets in one task is corners, whatever the size of the group. Points with a null coordinate are left out.
    """
    rows = points.select(F.col(group).alias("group"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    kind = rows.schema["group"].dataType.simpleString()

    def partial(batches):
        kept = None
        for b in batches:
            frame = b.to_pandas() if kept is None else pd.concat([kept, b.to_pandas()])
            kept = pd.concat([_corners(g, f) for g, f in frame.groupby("group", dropna=False)]) if len(frame) else frame
        if kept is not None:
            yield from pa.Table.from_pandas(kept, schema=arrow, preserve_index=False).to_batches()

    def _corners(g, f):
        return pd.DataFrame(hull(f[["x", "y"]].to_numpy()), columns=["x", "y"]).assign(group=f["group"].iloc[0])[["group", "x", "y"]]

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        return _corners(None, f)

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        h = hull(f[["x", "y"]].to_numpy())
        n = np.roll(h, -1, 0)
        area = abs((h[:, 0] * n[:, 1] - n[:, 0] * h[:, 1]).sum()) / 2 if len(h) > 2 else 0.0
        return pd.DataFrame([(f["group"].iloc[0], len(h), area, *_rectangle(h))], columns=["group", "corners", "area", "cx", "cy", "long", "short", "angle"])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(rows.schema)
    spec = f"group {kind}, x double, y double"
    parts = rows.mapInArrow(partial, spec).withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(16)))
    merged = parts.groupBy("group", "salt").applyInPandas(lambda f: merge(f), spec)
    return merged.groupBy("group").applyInPandas(whole, f"group {kind}, corners int, area double, cx double, cy double, long double, short double, angle double")


# --- distance fields -----------------------------------------------------------------------------------


def _envelope(seeds: np.ndarray, height2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over the seeds of (at - seed)^2 + height2, by the lower envelope of the parabolas; all ascending."""
    hull_, since = [0], [-np.inf]
    for k in range(1, len(seeds)):
        while True:
            j = hull_[-1]
            cross = ((height2[k] + seeds[k] ** 2) - (height2[j] + seeds[j] ** 2)) / (2 * (seeds[k] - seeds[j]))
            if cross > since[-1]:
                break
            hull_.pop()
            since.pop()
        hull_.append(k)
        since.append(cross)
    pick = np.array(hull_)[np.searchsorted(np.array(since), at, "right") - 1]
    return (at - seeds[pick]) ** 2 + height2[pick]


def distance_field(cells: DataFrame, seed: Column, size: float) -> DataFrame:
    """``row, col, distance``: from each cell's centre to the nearest cell where ``seed`` holds, exactly; null if there is none.

    Two passes, linear in the cells of the bounding box: windows give the nearest seed of a cell's column, the lower envelope of parabolas
    along each row the nearest of all. A task holds one row of cells at a time, or several of about 65,536 cells; a missing cell has no distance.
    """
    known = cells.select("row", "col", F.coalesce(seed, F.lit(False)).alias("seed"))
    box = known.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if box[0] is None:
        return known.select("row", "col", F.lit(None).cast("double").alias("distance"))
    wide, i = box[3] - box[2] + 1, F.col("id")
    frame = cells.sparkSession.range((box[1] - box[0] + 1) * wide).select((F.floor(i / wide) + box[0]).alias("row"), (i % wide + box[2]).alias("col"))
    marked = frame.join(known.hint("merge"), ["row", "col"], "left").select("row", "col", F.col("seed").isNotNull().alias("have"), F.coalesce("seed", F.lit(False)).alias("seed"))
    up = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)  # a frame to the end would be read anew for every row
    own = F.when(F.col("seed"), F.col("row"))
    gap = F.least(F.col("row") - F.max(own).over(up), F.min(own).over(down) - F.col("row"))
    columns = marked.select("row", "col", "have", gap.alias("gap"))

    def along(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["row", "col"])
        near, at, gap = f["gap"].notna().to_numpy(), f["col"].to_numpy(float), f["gap"].to_numpy(float)
        found = np.full(len(f), np.nan)
        starts = np.flatnonzero(np.diff(f["row"].to_numpy(), prepend=f["row"].iloc[0] - 1))
        for s in np.split(np.arange(len(f)), starts[1:]):
            n = s[near[s]]
            if len(n):
                found[s] = np.sqrt(_envelope(at[n], gap[n] ** 2, at[s])) * size
        return pd.DataFrame({"row": f["row"], "col": f["col"], "distance": found})[f["have"].to_numpy()]

    rows = F.floor(F.col("row") / max(1, 65536 // wide)).alias("rows")
    found = columns.groupBy(rows).applyInPandas(along, "row long, col long, distance double")
    return found.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
