"""Embedding near-duplicates by small-world graphs, one per shard.

Equal vectors of a label are one class first. The classes of a label are dealt to shards by a hash, each shard gets a
hierarchical navigable small-world graph, and the graphs are a table in the shared folder. Every shard is then asked for the
neighbours of every class of its label: a task holds two shards and asks either graph with the vectors of the other, so that a
link found from one side counts for both. Beams widen until an audit passes: planted queries at exactly the similarity asked for,
made from a fixed choice of stored vectors, have to find their vector and all that brute force finds for them. What the graphs
propose is verified by cosine in double precision. A task returns, per class, the number of linked vectors and the smallest class that
it reaches inside the task, never the pairs, so that a group of any size gives linear output; components are the union of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialise, table
from .hnsw import DEGREE, UPPER, Graph
from .simhash import components

#: Classes of a shard, about; a task holds the vectors of two shards and a bit for each pair between them.
SHARD = 8192
#: Planted queries of an audit, the recall they have to reach, and the beam that is tried first.
AUDIT, RECALL, BEAM = 64, 0.99, 32


def _vectors(column, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _build(rows: pa.Table) -> pa.Table:
    """A shard's rows with their layer and links: DEGREE for layer 0, then UPPER for each layer up to theirs."""
    rows = rows.sort_by("id")
    g = Graph.of(_vectors(rows.column("vec"), rows.column("size")[0].as_py()), rows.column("id").to_numpy())
    depth = np.minimum(g.level + 1, g.top)
    links = [np.concatenate([g.links[i][k] for i in range(depth[k])] or [np.zeros(0, np.int32)]) for k in range(g.n)]
    return rows.append_column("level", pa.array(g.level)).append_column("links", pa.array(links, pa.list_(pa.int32())))


def _load(rows: pa.Table) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of a shard from its rows, with unit vectors, ids (ascending), tags and class sizes."""
    rows = rows.sort_by("id")
    x, level = _vectors(rows.column("vec"), rows.column("size")[0].as_py()), rows.column("level").to_numpy()
    flat, sizes = rows.column("links").combine_chunks().flatten().to_numpy(), rows.column("links").combine_chunks().value_lengths().to_numpy()
    starts, links, layer = np.cumsum(sizes) - sizes, [], 0
    while len(flat) and (sizes > (at := DEGREE + UPPER * (layer - 1) if layer else 0)).any():
        width = UPPER if layer else DEGREE
        nodes = np.flatnonzero(sizes > at)
        part = np.full((len(x), width), -1, np.int32)
        part[nodes] = flat[(starts[nodes] + at)[:, None] + np.arange(width)]
        links.append(part)
        layer += 1
    return Graph(x, level, links), x, *(rows.column(c).to_numpy() for c in ("id", "tag", "n"))


def audited(g: Graph, x: np.ndarray, q: np.ndarray, least: float, ef: int = BEAM) -> tuple[np.ndarray, int, float]:
    """``within`` at the first beam whose audit passes: what it finds, the beam and its recall.

    An audit plants up to AUDIT queries: stored vectors at even distances, turned away by exactly the angle of ``least``.
    """
    at = np.unique(np.linspace(0, len(x) - 1, AUDIT).astype(np.int64))
    turn = np.random.default_rng(5).standard_normal((len(at), x.shape[1]))
    turn -= (turn * x[at]).sum(1)[:, None] * x[at]
    norm = np.sqrt((turn * turn).sum(1))[:, None]
    planted = np.where(norm > 1e-9, least * x[at] + np.sqrt(max(0.0, 1 - least * least)) * turn / np.maximum(norm, 1e-9), x[at])
    true = planted @ x.T >= least - 1e-6
    while True:
        recall = (g.within(planted, least, ef) & true).sum() / max(1, true.sum())
        if recall >= RECALL or 4 * ef > g.n:
            return g.within(q, least, ef), ef, recall
        ef *= 2


def _verified(found: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """``found`` without the pairs of rows of ``a`` and ``b`` whose cosine in double precision is below ``least``."""
    out = np.zeros(found.shape, bool)
    for lo in range(0, len(a), 256):
        r, c = np.nonzero(found[lo : lo + 256])
        for k in range(0, len(r), 65536):
            i, j = r[k : k + 65536] + lo, c[k : k + 65536]
            fine = np.einsum("ij,ij->i", a[i], b[j]) >= least
            out[i[fine], j[fine]] = True
    return out


def _reach(linked: np.ndarray, ids: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """The smallest id reachable for the rows and for the columns of a link matrix, and the numbers of their components (-1: none).

    ``other`` None: rows and columns are the same nodes. Ids ascend.
    """
    n, m = linked.shape
    row, col = ids.copy(), (ids if other is None else other).copy()
    row_at, col_at, number = np.full(n, -1), np.full(m, -1), 0
    new_r = linked.any(1)
    while new_r.any():
        at = int(np.flatnonzero(new_r)[0])
        rows, cols = np.zeros(n, bool), np.zeros(m, bool)
        edge = np.array([at])
        rows[at] = True
        while len(edge):
            more = linked[edge].any(0) & ~cols
            cols |= more
            nodes = np.flatnonzero(more)
            reached = more if other is None else (linked[:, nodes].any(1) if len(nodes) else np.zeros(n, bool))
            reached = reached & ~rows
            rows |= reached
            edge = np.flatnonzero(reached)
        least = min([*ids[rows][:1], *(ids if other is None else other)[cols][:1]])
        row[rows], col[cols], row_at[rows], col_at[cols] = least, least, number, number
        new_r &= ~rows
        number += 1
    return row, col, row_at, col_at


def _closed(linked: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, other: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``linked`` with the links that a search missed inside its own components, which are compared in full, and their smallest ids.

    A component lies within a shard's rows and columns, and comes out as booleans, not as pairs.
    """
    row, col, row_at, col_at = _reach(linked, ids, other)
    order_r, order_c = np.argsort(row_at, kind="stable"), np.argsort(col_at, kind="stable")
    groups = np.unique(row_at[row_at >= 0])
    for lo_r, hi_r, lo_c, hi_c in zip(*(np.searchsorted(v[o], groups, side) for v, o in ((row_at, order_r), (col_at, order_c)) for side in ("left", "right")), strict=True):
        r, c = order_r[lo_r:hi_r], order_c[lo_c:hi_c]
        if len(r) * len(c) > 1:
            for lo in range(0, len(r), 1024):
                linked[np.ix_(r[lo : lo + 1024], c)] |= a[r[lo : lo + 1024]] @ b[c].T >= least
    if other is None:
        np.fill_diagonal(linked, False)
    return linked, row, col


def _counts(linked: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For every row, the number of vectors in the classes linked."""
    return np.concatenate([linked[lo : lo + 256] @ n for lo in range(0, len(linked), 256)])


def _search(least: float):
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts and reached classes between two shards, or within one where ``right`` is empty."""
        if not left.num_rows or (not right.num_rows and left.column("s")[0].as_py() != left.column("t")[0].as_py()):
            return schema.empty_table()
        g, x, ids, tags, n = _load(left)
        if not right.num_rows:
            found = audited(g, x, x, least)[0]
            np.fill_diagonal(found, False)
            found, root, _ = _closed(_verified(found | found.T, x, x, least), x, x, ids, None, least)
            out = [(ids, tags, _counts(found, n), root)]
        else:
            h, y, others, marks, m = _load(right)
            found = _verified(audited(g, x, y, least)[0].T | audited(h, y, x, least)[0], x, y, least)
            found, row, col = _closed(found, x, y, ids, others, least)
            out = [(ids, tags, _counts(found, m), row), (others, marks, _counts(found.T, n), col)]
        parts = [pa.table([v[c > 0] for v in (i, t, c, r)], schema=schema) for i, t, c, r in out]
        return pa.concat_tables(parts)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """Near-duplicate vectors within a label: ``vec_id, n_links, component_id, kept``, one row per row of ``vectors``.

    ``vectors`` has ``vec_id long, embedding array, label``. Two rows link if their labels are equal and not null, their
    vectors have one length and a cosine of at least ``least``; ``n_links`` counts the other rows linked, ``component_id`` is the smallest ``vec_id``
    reachable, ``kept`` tells whether it is the row's own. No link below ``least`` is returned; links are found by
    approximate search, whose audit asks for a recall of 0.99.

    Rows link with nothing if ``vec_id``, ``label`` or ``embedding`` is null, a component is null or not finite, or all are
    zero; they are kept, but a null ``vec_id`` has a null component and is not. Equal rows link with each other; rows that share
    a ``vec_id`` share a component. A vector of any length is one value in a task. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
    sound = F.coalesce(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    with Scratch(spark, "vectors") as kept:
        classes = rows.where(sound).groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
        # a class is known by its smallest id and a tag, as several vectors may share an id
        classes = kept.table(classes.withColumn("size", F.size("vec")).withColumn("tag", F.xxhash64("label", "vec")), "classes")
        shards = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
        dealt = classes.join(shards, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("id", "tag"), "shards").cast("int"))
        spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
        index = dealt.groupBy("label", "size", "shard").applyInArrow(_build, spec + ", level long, links array<int>")
        index = kept.table(index, "graphs")
        left = index.withColumn("s", F.col("shard")).withColumn("t", F.explode(F.sequence("shard", F.col("shards") - 1)))
        right = index.where("shard > 0").withColumn("t", F.col("shard")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shard") - 1)))
        key = ["label", "size", "s", "t"]
        found = left.groupBy(*key).cogroup(right.select(left.columns).groupBy(*key)).applyInArrow(_search(least), "id long, tag long, n_links long, root long")
        found = kept.table(found, "links")
        groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), classes.select(F.col("id").alias("node")).distinct())
        counts = found.groupBy("id", "tag").agg(F.sum("n_links").alias("found"))
        member = classes.join(counts, ["id", "tag"], "left").join(groups, F.col("id") == F.col("node"))
        member = member.select("label", "vec", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("component").alias("component_id"))
        member = materialise(member, "vector-groups")
    joined = rows.withColumn("key", F.when(sound, F.col("vec"))).join(member.withColumnRenamed("vec", "key"), ["label", "key"], "left")
    group = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.coalesce(F.col("vec_id") == group, F.lit(False)).alias("kept")
    )


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of ``embeddings`` within a label, at a cosine of 0.93; rows as ``near_vectors`` defines them."""
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


ORACLE = """
with recursive sound as materialized (
  select row_number() over () as n, vec_id, label, embedding::double[] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as materialized (
  select a.n as a, b.n as b, b.vec_id as other from sound a join sound b on a.label = b.label and len(a.v) = len(b.v) and a.n <> b.n
  where list_cosine_similarity(a.v, b.v) >= 0.93
), steps as (
  select distinct a.vec_id as u, b.vec_id as v from pairs p join sound a on a.n = p.a join sound b on b.n = p.b
), reach(u, v) as (
  select distinct vec_id, vec_id from sound
  union
  select reach.u, steps.v from reach join steps on reach.v = steps.u
), least as (select u, min(v) as component_id from reach group by u),
counts as (select a, count(*) as n_links from pairs group by a),
known as (
  select s.vec_id, coalesce(c.n_links, 0)::bigint as n_links, l.component_id from sound s left join counts c on c.a = s.n join least l on l.u = s.vec_id
), rest as (
  select vec_id, 0::bigint as n_links, vec_id as component_id from embeddings
  where vec_id is null or label is null or embedding is null or len(embedding) = 0
    or len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 or len(list_filter(embedding, lambda x: x <> 0)) = 0
)
select *, coalesce(vec_id = component_id, false) as kept from (select * from known union all select * from rest)
"""
