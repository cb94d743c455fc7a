"""Rasters in long form: ``row, col, v``, row 0 at the north edge, missing cells absent or null.

A grid has its cells' centres at ``x = x0 + (col + 0.5) * size``, ``y = y0 - (row + 0.5) * size``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.session import checkpointed

#: The order of the eight neighbours; the first wins ties.
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    size: float
    width: int
    height: int

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.size).cast("long")

    def row(self, y: Column) -> Column:
        return F.floor((self.y0 - y) / self.size).cast("long")

    def x(self, col: Column) -> Column:
        return self.x0 + (col + 0.5) * self.size

    def y(self, row: Column) -> Column:
        return self.y0 - (row + 0.5) * self.size


def sample(points: DataFrame, cells: DataFrame, grid: Grid, how: str = "left") -> DataFrame:
    """Value of the cell that holds each point (``x, y``), as ``v``."""
    at = points.withColumn("row", grid.row(F.col("y"))).withColumn("col", grid.col(F.col("x")))
    return at.join(cells.select("row", "col", "v"), ["row", "col"], how).drop("row", "col")


def bilinear(points: DataFrame, cells: DataFrame, grid: Grid, point_id: str) -> DataFrame:
    """``point_id, v`` between the four nearest cell centres; weights of missing ones go to the others."""
    u, t = (F.col("x") - grid.x0) / grid.size - 0.5, (grid.y0 - F.col("y")) / grid.size - 0.5
    c, r = F.floor(u).cast("long"), F.floor(t).cast("long")
    fu, ft = u - c, t - r
    corner = lambda dr, dc, w: F.struct((r + dr).alias("row"), (c + dc).alias("col"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - fu) * (1 - ft)), corner(0, 1, fu * (1 - ft)), corner(1, 0, (1 - fu) * ft), corner(1, 1, fu * ft))
    want = points.select(point_id, F.explode(four).alias("k")).select(point_id, "k.*").where("w > 0")
    found = want.join(cells.where("v is not null").select("row", "col", "v").hint("merge"), ["row", "col"])
    return found.groupBy(point_id).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def overlay(base: DataFrame, top: DataFrame) -> DataFrame:
    """Cells of ``top`` where they have a value, else of ``base``."""
    t = top.where("v is not null").select("row", "col", F.col("v").alias("t"))
    return base.join(t, ["row", "col"], "full_outer").select("row", "col", F.coalesce("t", "v").alias("v"))


def resample(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Nearest source cell at every target cell's centre."""
    spark = cells.sparkSession
    t = spark.range(target.width * target.height).select(F.floor(F.col("id") / target.width).cast("long").alias("trow"), (F.col("id") % target.width).alias("tcol"))
    at = t.withColumn("row", source.row(target.y(F.col("trow")))).withColumn("col", source.col(target.x(F.col("tcol"))))
    return at.join(cells, ["row", "col"]).select(F.col("trow").alias("row"), F.col("tcol").alias("col"), "v")


def neighbours(cells: DataFrame, value: str = "v") -> DataFrame:
    """``row, col, k, n``: the value ``n`` of each existing neighbour number ``k``."""
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(NEIGHBOURS)])
    # a cell offers its value to the cell on the other side of the offset
    give = cells.select("row", "col", value, F.explode(offsets).alias("o"))
    return give.select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), F.col("o.k").alias("k"), F.col(value).alias("n"))


def flow_directions(cells: DataFrame, size: float) -> DataFrame:
    """D8: ``row, col, v, k`` with the neighbour of steepest descent, -1 at sinks. Ties go to the first neighbour."""
    step = F.when(F.col("k").isin(0, 2, 5, 7), size * math.sqrt(2.0)).otherwise(size)
    pairs = cells.select("row", "col", "v").join(neighbours(cells), ["row", "col"]).where("n is not null and v is not null")
    down = pairs.withColumn("slope", (F.col("v") - F.col("n")) / step).where("slope > 0")
    best = down.groupBy("row", "col").agg(F.max(F.struct("slope", (-F.col("k")).alias("m"))).alias("b"))
    return cells.join(best, ["row", "col"], "left").select("row", "col", "v", F.coalesce(-F.col("b.m"), F.lit(-1)).alias("k"))


def receivers(directions: DataFrame) -> DataFrame:
    """``row, col, trow, tcol`` of every cell that drains into another."""
    dr, dc = (F.element_at(F.array(*[F.lit(o[i]) for o in NEIGHBOURS]), F.col("k") + 1) for i in (0, 1))
    return directions.where("k >= 0").select("row", "col", (F.col("row") + dr).alias("trow"), (F.col("col") + dc).alias("tcol"))


def accumulate(directions: DataFrame, width: int) -> DataFrame:
    """``row, col, acc``: cells that drain through each cell, itself included.

    Pointer doubling along the receivers: after round i every cell has handed its count to the cells at most
    2 ** i steps downstream, so the rounds are the logarithm of the longest flow path.
    """
    cell = F.col("row") * width + F.col("col")
    jump = receivers(directions).select(cell.alias("c"), (F.col("trow") * width + F.col("tcol")).alias("t"))
    acc = totals(directions.select(cell.alias("c"), F.lit(1).cast("long").alias("acc")), jump)
    return acc.select(F.floor(F.col("c") / width).cast("long").alias("row"), (F.col("c") % width).alias("col"), "acc")


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``c, acc``: every node's own ``acc`` and that of all nodes upstream, in a forest of ``c, t`` edges; by doubling."""
    acc, jump = checkpointed(nodes.select("c", "acc")), checkpointed(edges.select("c", "t"))
    while not jump.isEmpty():
        moved = jump.join(acc, "c").groupBy("t").agg(F.sum("acc").alias("more"))
        acc = checkpointed(acc.join(moved, acc["c"] == moved["t"], "left").select("c", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
        ahead = jump.select(F.col("c").alias("t"), F.col("t").alias("t2"))
        jump = checkpointed(jump.join(ahead, "t").select("c", F.col("t2").alias("t")))
    return acc


def roots(edges: DataFrame) -> DataFrame:
    """``c, root, steps`` for every node with an edge in a forest of ``c, t``: the last node downstream and how many edges away, or the sum of their ``steps`` if edges have such; by doubling."""
    steps = F.col("steps") if "steps" in edges.columns else F.lit(1)
    far = checkpointed(edges.select("c", F.col("t").alias("root"), steps.cast("long").alias("steps")))
    while True:
        ahead = far.select(F.col("c").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        far = checkpointed(far.join(ahead, "root", "left").select("c", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        if far.where("moved").isEmpty():
            return far.drop("moved")
        far = far.drop("moved")


def slope(cells: DataFrame, size: float) -> DataFrame:
    """``row, col, slope`` in degrees by central differences; the edge repeats its own value."""
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    near = lambda f, w: F.coalesce(f("v", 1).over(w), F.col("v"))
    d = cells.withColumn("dx", (near(F.lead, across) - near(F.lag, across)) / (2 * size)).withColumn("dy", (near(F.lead, down) - near(F.lag, down)) / (2 * size))
    return d.select("row", "col", F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))).alias("slope"))


def wetness(acc: Column, slope_deg: Column, size: float) -> Column:
    """Topographic wetness index, with slopes below half a degree taken as that."""
    return F.log(F.greatest(acc * size, F.lit(size)) / F.tan(F.radians(F.greatest(slope_deg, F.lit(0.5)))))


def box_mean(cells: DataFrame, reach: int = 2) -> DataFrame:
    """Mean over a square window of ``2 * reach + 1`` cells that repeats the edge: rows first, then columns."""

    def pass_(df: DataFrame, along: str, across: str) -> DataFrame:
        w = Window.partitionBy(across).orderBy(along)
        full = Window.partitionBy(across)
        first, last = F.first("v").over(w), F.last("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        at, n = F.row_number().over(w), F.count("*").over(full)
        inner = F.sum("v").over(w.rowsBetween(-reach, reach))
        short = first * F.greatest(reach + 1 - at, F.lit(0)) + last * F.greatest(at + reach - n, F.lit(0))
        return df.withColumn("m", (inner + short) / (2 * reach + 1)).drop("v").withColumnRenamed("m", "v")

    return pass_(pass_(cells.select("row", "col", "v"), "col", "row"), "row", "col")


def percent_rank(cells: DataFrame) -> DataFrame:
    """``row, col, pct`` in 0..1 by value, ties by cell. Ranks come from counts below each value, so no task sorts all."""
    by_value, n = _below(cells)
    within = Window.partitionBy("v").orderBy("row", "col")
    ranked = cells.where("v is not null").join(by_value, "v").withColumn("at", F.col("below") + F.row_number().over(within) - 1)
    return ranked.select("row", "col", (F.col("at") / F.greatest(F.lit(n - 1), F.lit(1))).alias("pct"))


def midrank(cells: DataFrame) -> DataFrame:
    """``row, col, pct``: the mean rank of equal values, in 0..1."""
    by_value, n = _below(cells)
    pct = (2 * F.col("below") + F.col("c") - 1) / F.greatest(F.lit(2 * (n - 1)), F.lit(1))
    return cells.where("v is not null").join(by_value, "v").select("row", "col", pct.alias("pct"))


def _below(cells: DataFrame) -> tuple[DataFrame, int]:
    """``v, c, below``: counts of each value and of all smaller ones; and the number of cells.

    Values are dealt out in ranges and added up inside each range; the ranges' totals, a row per
    partition, give the offsets.
    """
    counts = cells.where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    parts = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpointed(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("c").alias("total"))
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("off"))
    inside = F.sum("c").over(Window.partitionBy("part").orderBy("v")) - F.col("c")
    n = ranged.agg(F.sum("c")).first()[0] or 0
    return ranged.join(F.broadcast(offsets), "part").select("v", "c", (F.col("off") + inside).alias("below")), n


def zonal(cells: DataFrame, inside: Column) -> DataFrame:
    """``v, n, share`` of each class among the cells where ``inside`` holds."""
    n = cells.where(inside).groupBy("v").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def block_peaks(cells: DataFrame, block: int, least: float) -> DataFrame:
    """The highest cell of every block that reaches ``least``; ties to the first cell."""
    b = cells.where(F.col("v") >= least).withColumn("br", F.floor(F.col("row") / block)).withColumn("bc", F.floor(F.col("col") / block))
    best = b.groupBy("br", "bc").agg(F.max(F.struct("v", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("m"))
    return best.select((-F.col("m.r")).alias("row"), (-F.col("m.c")).alias("col"), F.col("m.v").alias("v"))


def rasterise(polygons: DataFrame, grid: Grid, value: str, order: str, ring: str = "ring") -> DataFrame:
    """Burn polygons onto cell centres; of overlapping ones the last in ``order`` wins."""
    from landloom.functions import geo

    box = geo.bbox(F.col(ring))
    span = lambda a, b, top: F.explode(F.sequence(F.greatest(a, F.lit(0).cast("long")), F.least(b, F.lit(top - 1).cast("long"))))
    meets = (box["max_x"] >= grid.x0) & (box["min_x"] < grid.x0 + grid.size * grid.width) & (box["min_y"] <= grid.y0) & (box["max_y"] > grid.y0 - grid.size * grid.height)
    at = polygons.where(meets).withColumn("row", span(grid.row(box["max_y"]), grid.row(box["min_y"]), grid.height)).withColumn("col", span(grid.col(box["min_x"]), grid.col(box["max_x"]), grid.width))
    hit = at.where(geo.in_ring(grid.x(F.col("col")), grid.y(F.col("row")), F.col(ring)))
    return hit.groupBy("row", "col").agg(F.max_by(value, order).alias("v"))


def label_components(cells: DataFrame, width: int) -> DataFrame:
    """``row, col, label`` of 8-connected groups of cells; the label is the group's smallest cell number.

    Labels spread to neighbours and jump to their label's label each round, so rounds stay far below a group's
    diameter. Each round's labels are a checkpoint.
    """
    c = F.col("row") * width + F.col("col")
    pairs = checkpointed(cells.join(neighbours(cells.withColumn("cell", c), "cell"), ["row", "col"]).select(c.alias("c"), F.col("n").alias("o")))
    now = checkpointed(cells.select(c.alias("c"), c.alias("label")))
    while True:
        offered = pairs.join(now.select(F.col("c").alias("o"), F.col("label").alias("l")), "o").groupBy("c").agg(F.min("l").alias("l"))
        least = now.join(offered, "c", "left").select("c", "label", F.least("label", F.coalesce("l", "label")).alias("new"))
        jump = least.select(F.col("c").alias("new"), F.col("new").alias("far"))
        done = checkpointed(least.join(jump, "new").select("c", "label", F.least("new", "far").alias("new")))
        changed = done.where("new <> label").isEmpty()
        now = done.select("c", F.col("new").alias("label"))
        if changed:
            return now.select(F.floor(F.col("c") / width).cast("long").alias("row"), (F.col("c") % width).alias("col"), "label")
