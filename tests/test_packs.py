"""Runoff on many small trees: shared tasks, and ponds that are levelled at once."""

import numpy as np
from pyspark.sql import functions as F

from landloom.operators import runoff


def test_small_chunks_share_a_task(spark):
    graph = spark.range(3000).select((F.col("id") % 1000).alias("chunk"), F.lit(0).alias("depth")).union(spark.range(runoff.CHUNK).select(F.lit(-7), F.lit(0)))
    packs = runoff._packs(graph)
    assert packs.count() == 1001 and packs.select("pack", "alone").distinct().count() == 2


def test_ponds_are_levelled_at_once_as_one_by_one():
    rng = np.random.default_rng(5)
    pond = np.array([3, -1, 8, 3, 8, 3, -1, 9])
    ground, room = rng.random(8) * 3, rng.random(8) + 0.1
    ponds = runoff.Ponds(pond, ground, room, 100.0)
    ponds.held = ponds.capacity * np.array([0.3, 0.0, 1.0])
    full, cells, deep = ponds.depths()
    assert full.tolist() == [0, 2] and cells.tolist() == [0, 3, 5, 7]
    assert np.allclose([deep[:3].sum() * 100, deep[3] * 100], ponds.held[full])
    level = (ground[cells] + deep)[(deep > 0) & (deep < room[cells] - 1e-12)]
    assert np.ptp(level) < 1e-9
    # two cells spill from one pond: the first fills it
    ponds.held[:] = ponds.capacity - np.array([5.0, 0.0, 1.0])
    assert np.allclose(ponds.catch(np.array([0, 3, 7]), np.array([4.0, 4.0, 4.0])), [0.0, 3.0, 3.0])
