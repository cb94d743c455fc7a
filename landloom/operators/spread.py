"""Least-cost spread over grids: fire arrival times and depression filling, tile by tile.

Both are a least fixed point over eight neighbours: arrival adds a cost per step, filling keeps the highest ground on
the way to the border. The first round solves each tile by itself; further rounds solve the tiles next to a rim that has
changed, from the changed cells of that rim, and hand their new rims on, until none changes. Rounds follow the number of tiles a path
crosses, not its cells, and a round's work the front. A task holds one tile.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.session import checkpointed

from .raster import NEIGHBOURS

TILE = 128


def _solve(mode: str, size: float, rise: float = 0.0):
    bearing = [math.atan2(dc, -dr) for dr, dc in NEIGHBOURS]
    length = [size * math.hypot(dr, dc) for dr, dc in NEIGHBOURS]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best values of a tile's own cells, from its start values and the rim around it."""
        t, own, cost = pdf["t"].tolist(), pdf["own"].tolist(), pdf["cost"].tolist()
        ratio, facing = pdf["ratio"].tolist(), pdf["facing"].tolist()
        # cells lie in a frame one wider than the rim; only a tile's own cells can be reached
        rows, cols = pdf["row"] - pdf["row"].min() + 1, pdf["col"] - pdf["col"].min() + 1
        wide = int(cols.max()) + 2
        place = (rows * wide + cols).tolist()
        here = [-1] * (wide * (int(rows.max()) + 2))
        for i, p in enumerate(place):
            if own[i]:
                here[p] = i
        offsets = [dr * wide + dc for dr, dc in NEIGHBOURS]
        ways = list(zip(offsets, bearing, length, strict=True))
        heap = [(v, i) for i, (v, b) in enumerate(zip(t, pdf["before"].tolist(), strict=True)) if v < math.inf and b > v]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            v, i = pop(heap)
            if v > t[i]:
                continue
            p = place[i]
            if mode == "fill":
                v += rise
                for o in offsets:
                    j = here[p + o]
                    if j >= 0:
                        new = cost[j] if cost[j] > v else v
                        if new < t[j] - 1e-12:
                            t[j] = new
                            push(heap, (new, j))
                continue
            e = math.sqrt(1 - 1 / (ratio[i] * ratio[i]))
            head, towards = cost[i] * (1 - e), math.radians(facing[i])
            for o, angle, far in ways:
                j = here[p + o]
                if j >= 0 and cost[j] > 0:
                    ros = head / (1 - e * math.cos(angle - towards))
                    new = v + far / ros if ros > 0 else math.inf
                    if new < t[j] - 1e-12:
                        t[j] = new
                        push(heap, (new, j))
        pdf["t"] = t
        return pdf[pdf["own"]][["row", "col", "cost", "ratio", "facing", "before", "t"]]

    return run


def spread(cells: DataFrame, mode: str, size: float = 1.0, tile: int = TILE, rise: float = 0.0) -> DataFrame:
    """``row, col, t`` from ``row, col, cost, ratio, facing, t`` with infinite ``t`` where nothing starts."""
    columns = ["row", "col", "cost", "ratio", "facing", "before", "t"]
    spec = ", ".join(f"{c} {'long' if c in ('row', 'col') else 'double'}" for c in columns)
    at = lambda row, col: [F.floor(row / tile).alias("tr"), F.floor(col / tile).alias("tc")]
    around = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in NEIGHBOURS])
    here = [F.col("row"), F.col("col")]
    own = cells.select("row", "col", "cost", "ratio", "facing", F.lit(float("inf")).alias("before"), "t", F.lit(True).alias("own"), *at(*here))
    # few bytes mean much work here: tiles are dealt over all partitions, which are not merged by their size
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, "tr", "tc").groupBy("tr", "tc")
    now = checkpointed(dealt(own).applyInPandas(_solve(mode, size, rise), spec))
    while True:
        near = now.where("t < before").withColumn("o", F.explode(around))
        lent = near.select("*", *at(*here), *[c.alias(f"to_{c_}") for c, c_ in zip(at(F.col("row") + F.col("o.dr"), F.col("col") + F.col("o.dc")), ("tr", "tc"))])
        lent = lent.where("tr <> to_tr or tc <> to_tc")
        lent = lent.select("row", "col", "cost", "ratio", "facing", F.lit(float("inf")).alias("before"), "t", F.lit(False).alias("own"), F.col("to_tr").alias("tr"), F.col("to_tc").alias("tc")).distinct()
        lent = checkpointed(lent)
        if lent.isEmpty():
            return now.select("row", "col", "t")
        tiled = now.select("row", "col", "cost", "ratio", "facing", F.col("t").alias("before"), "t", F.lit(True).alias("own"), *at(*here))
        front = lent.select("tr", "tc").distinct()
        again = dealt(tiled.join(front, ["tr", "tc"], "left_semi").unionByName(lent)).applyInPandas(_solve(mode, size, rise), spec)
        now = checkpointed(tiled.join(front, ["tr", "tc"], "left_anti").select(*columns).union(again))


def fill_depressions(cells: DataFrame, rise: float = 0.0) -> DataFrame:
    """``row, col, v, filled``: every cell raised to the least level from which water reaches the border.

    Border cells and cells next to missing ones keep their height. Filled ground rises by ``rise`` per cell away from where it
    drains, so that with a positive one every inner cell has a lower neighbour; ``depth`` is ``filled - v``.
    """
    from .raster import neighbours

    have = cells.where("v is not null")
    inner = have.select("row", "col").join(neighbours(have), ["row", "col"]).where("n is not null").groupBy("row", "col").agg(F.count("*").alias("n"))
    start = F.when(F.coalesce(F.col("n"), F.lit(0)) < 8, F.col("v")).otherwise(F.lit(float("inf")))
    grid = have.join(inner, ["row", "col"], "left").select("row", "col", F.col("v").alias("cost"), F.lit(1.0).alias("ratio"), F.lit(0.0).alias("facing"), start.alias("t"))
    return have.join(spread(grid, "fill", rise=rise), ["row", "col"]).select("row", "col", "v", F.col("t").alias("filled"))


def arrival_times(cells: DataFrame, size: float, start: Column) -> DataFrame:
    """``row, col, t`` minutes until fire arrives, from ``row, col, ros`` (head, m/min), ``ratio`` and ``facing`` (length to
    width and downwind azimuth). A step takes the spread of the cell it leaves, along its ellipse; cells with no
    spread do not burn. Cells never reached have infinite ``t``."""
    grid = cells.select("row", "col", F.col("ros").alias("cost"), F.greatest("ratio", F.lit(1.0)).alias("ratio"), "facing", F.when(start, 0.0).otherwise(float("inf")).alias("t"))
    return spread(grid, "arrival", size)
