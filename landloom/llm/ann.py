"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Vectors are projected to a few dimensions by a fixed Gaussian matrix; a squared projected distance then
is the squared true distance times a chi-square variable. A kd-tree over projections cuts the vectors
into cells, and a tree of its own each block of a cell into leaves. Inside a block a query takes the vectors by rising projected
distance, verifies them in batches with exact inner products, and stops once the chi-square test holds: with d the
distance of the k-th neighbour found, beyond the projected radius r with P(chi2 <= r^2 / d^2) >= confidence a true
neighbour is unlikely. A query first meets its own cell, then every cell whose box comes within that radius, with the
bound that the first gave. Inner products are computed for verified vectors only.

Largest inner product becomes least distance by one more coordinate, which lifts all vectors to one norm.
The tree is fitted on a bounded sample of projections; every vector is indexed. Cells of any size are cut
into blocks by a hash of the id, and a cell's queries into chunks, so that a task holds one block and one chunk.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Projected dimensions; even, for the closed form of the chi-square distribution.
DIMS = 32
#: At most this many projections fit the tree.
SAMPLE = 20_000
#: Vectors of a block, of a leaf of its tree, and queries of a chunk, about.
BLOCK, LEAF, CHUNK = 4096, 32, 2048


def chi2_quantile(p: float, dims: int) -> float:
    """The quantile of the chi-square distribution with an even number of degrees of freedom."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree as arrays; node i has children 2i+1 and 2i+2, leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, inner = depth, 2**depth - 1
        self.axis, self.cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        parts = {0: points}
        for i in range(inner):
            p = parts.pop(i)
            if len(p):
                spread = p.max(0) - p.min(0)
                self.axis[i] = spread.argmax()
                self.cut[i] = np.median(p[:, self.axis[i]])
            side = p[:, self.axis[i]] > self.cut[i]
            parts[2 * i + 1], parts[2 * i + 2] = p[~side], p[side]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[rows, self.axis[at]] > self.cut[at])
        return at - (2**self.depth - 1)


class Projection:
    """Lift to norm ``top`` and projection to DIMS dimensions."""

    def __init__(self, size: int, top: float, seed: int = 17):
        self.size, self.top = size, top
        self.matrix = np.random.default_rng(seed).standard_normal((size + 1, DIMS))

    def stored(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0.0))
        return x @ self.matrix[:-1] + lift[:, None] * self.matrix[-1]

    def query(self, q: np.ndarray) -> np.ndarray:
        return (q * self.scale(q)[:, None]) @ self.matrix[:-1]

    def scale(self, q: np.ndarray) -> np.ndarray:
        return self.top / np.sqrt((q * q).sum(1))


def _matrix(column, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


class Block:
    """Vectors of one task under a kd-tree of their projections, down to leaves of about LEAF vectors."""

    def __init__(self, proj: Projection, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((*x.T[::-1], ids))
        x, ids = x[order], ids[order]
        new = np.ones(len(ids), bool)  # a row that repeats counts once
        new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)
        x, ids = x[new], ids[new]
        p = proj.stored(x)
        leaf = Tree(p, max(0, math.ceil(math.log2(max(1, len(ids)) / LEAF)))).leaf(p)
        order = np.argsort(leaf, kind="stable")
        self.proj, self.x, self.ids, self.p = proj, x[order], ids[order], p[order]
        self.half = (self.p * self.p).sum(1) / 2
        self.starts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        self.ends = np.append(self.starts[1:], len(ids))
        self.low, self.high = np.minimum.reduceat(self.p, self.starts), np.maximum.reduceat(self.p, self.starts)

    def search(self, q: np.ndarray, own: int, k: int, floor: float, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best ``k`` that score at least ``floor``, and how many vectors were verified.

        Vectors come by rising projected distance: leaves open by the distance of their boxes, and a vector is ready once
        no closed leaf can hold a nearer one. They are verified in batches, each with its inner products, until the
        next projected distance is over ``limit`` times the distance of the k-th neighbour found. Leaves are opened in few
        rounds, all in reach once there is a bound; products are taken by matrix and those that can count again one by one,
        so that a score never depends on its batch.
        """
        proj, top, scale = self.proj, self.proj.top, self.proj.scale(q[None])[0]
        p = proj.query(q[None])[0]
        gap = np.maximum(np.maximum(self.low - p, p - self.high), 0.0)
        gap = (gap * gap).sum(1)
        order = np.argsort(gap, kind="stable")
        gap = np.append(gap[order], np.inf)
        slack = 1e-9 * top * top
        reach = lambda kth: limit * max(0.0, 2 * top * top - 2 * scale * kth) + slack if kth > -np.inf else np.inf
        best_s, best_i, kth = np.zeros(0), np.zeros(0, np.int64), floor
        pool_d, pool_i, opened, batch, verified = np.zeros(0), np.zeros(0, np.int64), 0, 4 * k, 0
        size = (p * p).sum()
        while True:
            ready = int(np.searchsorted(pool_d, gap[opened], "right"))
            if ready < batch and opened < len(order) and gap[opened] <= reach(kth):
                # without a bound a quarter of the leaves at a time, then all in reach
                most = len(order) // 4 if kth == -np.inf else len(order)
                n = max(1, min(most, int(np.searchsorted(gap[opened:-1], reach(kth), "right"))))
                picked = np.zeros(len(order), bool)
                picked[order[opened : opened + n]] = True
                at = np.flatnonzero(np.repeat(picked, self.ends - self.starts))
                opened += n
                near = self.p if len(at) == len(self.p) else self.p[at]
                d = np.maximum(2 * (self.half[at] - near @ p) + size, 0.0)
                keep = d <= reach(kth)
                pool_d, pool_i = np.append(pool_d, d[keep]), np.append(pool_i, at[keep])
                by = np.argsort(pool_d, kind="stable")
                pool_d, pool_i = pool_d[by], pool_i[by]
                continue
            take = min(ready, batch, int(np.searchsorted(pool_d, reach(kth), "right")))
            if not take:
                return best_i, best_s, verified
            at, pool_d, pool_i, batch = pool_i[:take], pool_d[take:], pool_i[take:], 4 * batch
            verified += take
            at = at[self.ids[at] != own]
            x = self.x[at]
            rough = x @ q
            least = np.partition(rough, len(at) - k)[len(at) - k] if len(at) > k else -np.inf
            good = rough >= max(kth, least) - 2 * slack
            score, ids = (x[good] * q).sum(1), self.ids[at[good]]
            fine = score >= kth - slack
            best_s, best_i = np.append(best_s, score[fine]), np.append(best_i, ids[fine])
            by = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[by], best_i[by]
            if len(best_s) == k:
                kth = max(kth, best_s[-1])


def _search(proj: Projection, k: int, limit: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best k of a block for each query of a chunk: left has vec_id, vec; right query_id, vec, floor."""
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        block = Block(proj, left.column("vec_id").to_numpy(), _matrix(left.column("vec"), proj.size))
        q, own, floor = _matrix(right.column("vec"), proj.size), right.column("query_id").to_numpy(), right.column("floor").to_numpy()
        found = [block.search(q[i], own[i], k, floor[i], limit) for i in range(len(q))]
        times = np.array([len(f[0]) for f in found])
        return pa.table([np.repeat(own, times), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, confidence: float = 0.95) -> DataFrame:
    """The ``k`` vectors of largest inner product for every query row: ``query_id, rank, vec_id, score``.

    ``vectors`` has ``vec_id long, embedding array``; ``is_query`` picks the query rows. Nearest first, ties to the
    smaller ``vec_id``; a query gets all candidates if they are fewer. Scores are exact, in double precision;
    which neighbours are found is approximate, and ``confidence`` sets how sure the stopping test has to be. On vectors without
    clusters the test stops late: a query then verifies half of all vectors or more, at any number of rows.

    Rows take no part if ``vec_id`` or ``embedding`` is null, a component is null or not finite, all are zero, or the
    length is not the most frequent one (the larger of two). A row that repeats counts once; of several vectors with
    a query's id, none is its candidate. Other columns are ignored. Without rows, there are no results.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c))
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("top"))
    found = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    result = "query_id long, rank int, vec_id long, score double"
    if found is None:
        return spark.createDataFrame([], result)
    proj = Projection(found["size"], found["top"])
    rows = rows.where(F.size("vec") == found["size"])

    def projected(batches):
        for b in batches:
            p = proj.stored(_matrix(b.column(1), proj.size))
            yield pa.record_batch([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), DIMS).cast(pa.list_(pa.float64()))], names=["vec_id", "p"])

    drawn = rows.select("vec_id", "vec").where(F.xxhash64("vec_id").bitwiseAND(F.lit(2**31 - 1)) < 2.0 * SAMPLE * 2**31 / found["n"])
    points = drawn.mapInArrow(projected, "vec_id long, p array<double>").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    points = np.array([r["p"] for r in points.collect()], float).reshape(-1, DIMS)
    depth = max(0, min(10, math.ceil(math.log2(max(1, found["n"] / BLOCK)))))
    tree = Tree(points, depth)

    def placed(batches):
        for b in batches:
            p = proj.stored(_matrix(b.column(1), proj.size))
            yield pa.record_batch([*b.columns, pa.array(tree.leaf(p)), *(pa.array(p[:, i]) for i in range(DIMS))], names=["vec_id", "vec", "asks", "cell", *axes])

    axes = [f"p{i}" for i in range(DIMS)]
    index = rows.mapInArrow(placed, "vec_id long, vec array<double>, asks boolean, cell long, " + ", ".join(f"{a} double" for a in axes))
    index = materialise(index, "ann-index")
    edges = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    # one row per leaf of the tree, of which there are at most 1024
    boxes = sorted(index.groupBy("cell").agg(F.count("*").alias("n"), *edges).collect(), key=lambda r: r["cell"])
    cells = np.array([r["cell"] for r in boxes])
    low, high = (np.array([[r[f"{n}_{a}"] for a in axes] for r in boxes]) for n in ("lo", "hi"))
    blocks = {r["cell"]: max(1, math.ceil(r["n"] / BLOCK)) for r in boxes}
    per_cell = F.create_map(*[F.lit(x) for c, n in blocks.items() if n > 1 for x in (c, n)]) if any(n > 1 for n in blocks.values()) else None
    count = F.coalesce(F.try_element_at(per_cell, F.col("cell")), F.lit(1)) if per_cell is not None else F.lit(1)
    stored = index.select("vec_id", "vec", "cell", F.pmod(F.xxhash64("vec_id"), count.cast("long")).alias("block"))
    n_blocks = np.array([blocks[c] for c in cells.tolist()], np.int64)
    limit = chi2_quantile(confidence, DIMS)

    def route(first: bool):
        """Rows for every (cell, block) that a query has to visit: first its nearest cell, then the rest in reach."""

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    q = _matrix(part.column(1), proj.size)
                    p = proj.query(q)
                    gap = np.maximum(np.maximum(low[None] - p[:, None], p[:, None] - high[None]), 0.0)
                    gap = (gap * gap).sum(2)
                    home = gap.argmin(1)
                    if first:
                        floor = np.full(len(q), -np.inf)
                        row, col = np.arange(len(q)), home
                    else:
                        floor = part.column(2).to_numpy(zero_copy_only=False)
                        kth = np.maximum(2 * proj.top**2 - 2 * proj.scale(q) * floor, 0.0)
                        reach = np.where(np.isfinite(floor), kth * limit, np.inf)
                        visit = gap <= reach[:, None] + 1e-9 * (1 + (p * p).sum(1))[:, None]
                        visit[np.arange(len(q)), home] = False
                        row, col = np.nonzero(visit)
                    times = n_blocks[col]
                    row, col = np.repeat(row, times), np.repeat(col, times)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    at = pa.array(row)
                    yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), pa.array(floor[row]), pa.array(cells[col]), pa.array(block)], names=["query_id", "vec", "floor", "cell", "block"])

        return run

    routed = "query_id long, vec array<double>, floor double, cell long, block long"

    def visit(asked: DataFrame) -> DataFrame:
        """Search all routed queries, a block of vectors against a chunk of queries at a time."""
        load = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        right = asked.join(load, ["cell", "block"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks"))
        left = stored.join(load, ["cell", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        key = ["cell", "block", "chunk"]
        return (
            left.select(*key, "vec_id", "vec").groupBy(*key)
            .cogroup(right.select(*key, "query_id", "vec", "floor").groupBy(*key))
            .applyInArrow(_search(proj, k, limit), "query_id long, vec_id long, score double")
        )

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    queries = index.where("asks").select(F.col("vec_id").alias("query_id"), "vec")
    asked = materialise(queries.mapInArrow(route(True), routed), "ann-route")
    near = materialise(visit(asked).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ann-near")
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("kth"))
    bounded = queries.join(kth, F.col("query_id") == F.col("of"), "left").select("query_id", "vec", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
    asked = materialise(bounded.mapInArrow(route(False), routed), "ann-route")
    both = near.drop("rank").union(visit(asked)).distinct()
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector of ``embeddings`` whose id is divisible by 20; null, zero and repeated vectors as ``nearest`` defines them."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
