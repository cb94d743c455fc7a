"""The entity store: append-only observations, runs, lifecycles, and states as of any run.

Observations are ``obs_id, entity_id, attr, value, run_id, ...``; the value of an attribute is the one with the
greatest ``obs_id``, which need not be the latest in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.session import checkpointed

from .filters import AttrFilter


def latest(observations: DataFrame, *attrs: str) -> DataFrame:
    """The last observation of every (entity, attribute). Naming the attributes filters before the shuffle."""
    if attrs:
        observations = observations.where(F.col("attr").isin(*attrs))
    rest = [c for c in observations.columns if c not in ("entity_id", "attr")]
    return observations.groupBy("entity_id", "attr").agg(F.max_by(F.struct(*rest), "obs_id").alias("o")).select("entity_id", "attr", *[F.col(f"o.{c}").alias(c) for c in rest])


def wide(observations: DataFrame, attrs: list[str]) -> DataFrame:
    """One row per entity with the latest value of each attribute as a column, in one pass."""
    found = observations.where(F.col("attr").isin(*attrs)).groupBy("entity_id")
    return found.agg(*[F.max_by(F.when(F.col("attr") == a, F.col("value")), F.when(F.col("attr") == a, F.col("obs_id"))).alias(a) for a in attrs])


def as_of(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """The value of every (entity, attribute) as of each of ``runs``: ``run_id, entity_id, attr, value``.

    Of the rows with ``run_id <= r`` the one with the greatest ``obs_id`` counts. One window over each key's runs takes
    the place of a join by range: first the best of every run, then the running best, then the numbers of the runs until the next. The result has a row per run and
    key by nature, so filter keys first. ``runs`` is the small dimension of pipeline runs.
    """
    best = F.max(F.struct("obs_id", "value"))
    per_run = observations.groupBy("entity_id", "attr", "run_id").agg(best.alias("v"))
    running = Window.partitionBy("entity_id", "attr").orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy("entity_id", "attr").orderBy("run_id")
    spans = per_run.select("entity_id", "attr", "run_id", F.max("v").over(running).alias("v"), F.lead("run_id").over(upto).alias("next"))
    # every run, asked for or only observed, with the number of asked ones before it: spans become ranges of numbers
    marks = runs.select("run_id", F.lit(1).alias("asked")).union(observations.select("run_id", F.lit(0)).distinct()).groupBy("run_id").agg(F.max("asked").alias("asked"))
    below = F.coalesce(F.sum("asked").over(Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = checkpointed(marks.select("run_id", "asked", below.alias("number")))
    total = marks.agg(F.sum("asked").alias("total"))
    ends = marks.select(F.col("run_id").alias("next"), F.col("number").alias("end"))
    ranged = spans.join(marks.select("run_id", "number"), "run_id").join(ends, "next", "left").join(F.broadcast(total))  # one row
    last = F.coalesce("end", "total") - 1
    numbered = ranged.where(F.col("number") <= last).withColumn("number", F.explode(F.sequence("number", last)))
    ticks = marks.where("asked = 1").select("number", F.col("run_id").alias("r"))
    return numbered.join(ticks, "number").select(F.col("r").alias("run_id"), "entity_id", "attr", F.col("v.value").alias("value"))


def changed_only(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Observations of a batch that change something: the value differs from the one before, in the batch or stored."""
    order = Window.partitionBy("entity_id", "attr").orderBy("obs_id")
    marked = batch.withColumn("before", F.lag("value").over(order)).withColumn("first", F.row_number().over(order) == 1)
    if stored is not None:
        last = latest(stored).select("entity_id", "attr", F.col("value").alias("stored"), F.lit(True).alias("known"))
        marked = marked.join(last, ["entity_id", "attr"], "left")
        same = F.when(F.col("first"), F.col("known").isNotNull() & F.col("value").eqNullSafe(F.col("stored"))).otherwise(F.col("value").eqNullSafe(F.col("before")))
    else:
        same = ~F.col("first") & F.col("value").eqNullSafe(F.col("before"))
    return marked.where(~same).select(batch.columns)


def alive(entities: DataFrame, run: int | None = None) -> DataFrame:
    """Entities not retired, now or as of a run."""
    if run is None:
        return entities.where("retired_run_id is null")
    return entities.where((F.col("created_run_id") <= run) & (F.col("retired_run_id").isNull() | (F.col("retired_run_id") > run)))


def alive_per_run(entities: DataFrame, runs: DataFrame, *sums: Column) -> DataFrame:
    """Entities alive in each run, ``run_id, n`` and summed ``sums``: counts up at creation, down at retirement, added up
    over the runs. The window runs over sums by run, not over entities."""
    named = [s.alias(f"s{i}") for i, s in enumerate(sums)]
    born = entities.select(F.col("created_run_id").alias("run_id"), F.lit(1).alias("d"), *named)
    gone = entities.where("retired_run_id is not null").select(F.col("retired_run_id").alias("run_id"), F.lit(-1).alias("d"), *named)
    steps = born.union(gone).union(runs.select("run_id", F.lit(0).alias("d"), *[F.lit(0).alias(f"s{i}") for i in range(len(sums))]))
    per_run = steps.groupBy("run_id").agg(F.sum("d").alias("d"), *[F.sum(F.col("d") * F.col(f"s{i}")).alias(f"s{i}") for i in range(len(sums))])
    over = Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)
    total = per_run.select("run_id", F.sum("d").over(over).alias("n"), *[F.sum(f"s{i}").over(over).alias(f"s{i}") for i in range(len(sums))])
    return total.join(runs.select("run_id"), "run_id", "left_semi")


def reconcile(previous: DataFrame, seen: DataFrame) -> DataFrame:
    """``entity_id, change``: what a full ingest created, kept or retired, from ids before and ids seen."""
    p, s = previous.select("entity_id", F.lit(True).alias("was")), seen.select("entity_id", F.lit(True).alias("is")).distinct()
    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "retired").otherwise("kept")
    return p.join(s, "entity_id", "full_outer").select("entity_id", change.alias("change"))


def diff(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """``entity_id, attr, change`` of staged values against the latest stored: created, updated or unchanged."""
    old = latest(stored).select("entity_id", "attr", F.col("value").alias("old"), F.lit(True).alias("known"))
    new = latest(staged).select("entity_id", "attr", F.col("value").alias("new"))
    change = F.when(F.col("known").isNull(), "created").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return new.join(old, ["entity_id", "attr"], "left").select("entity_id", "attr", change.alias("change"))


def history(observations: DataFrame, entity_id: str, attr: str | None = None) -> DataFrame:
    """The observations of one entity, oldest first."""
    found = observations.where(F.col("entity_id") == entity_id)
    return (found if attr is None else found.where(F.col("attr") == attr)).orderBy("obs_id")


def ancestry(nodes: DataFrame, start: str) -> DataFrame:
    """``depth, id`` from a node to its root along ``parent``; stops at a cycle or a missing parent.

    Pointers double: each round every node knows an ancestor twice as far, and the path found so far is carried that far
    again. So the rounds are the logarithm of the depth, which may be any.
    """
    ids = nodes.select(F.col("id").alias("up"))
    jump = checkpointed(nodes.select("id", F.col("parent").alias("up")).join(ids, "up", "left_semi").select("id", "up"))
    path = checkpointed(nodes.where(F.col("id") == start).select(F.lit(0).alias("depth"), "id").distinct())
    step, known = 1, path.count()
    while known:
        further = path.join(jump, "id").select((F.col("depth") + step).alias("depth"), F.col("up").alias("id"))
        path = checkpointed(path.union(further).groupBy("id").agg(F.min("depth").alias("depth")).select("depth", "id"))
        before, known, step = known, path.count(), 2 * step
        if known == before:
            break
        onward = jump.select(F.col("id").alias("up"), F.col("up").alias("to"))
        jump = checkpointed(jump.join(onward, "up").select("id", F.col("to").alias("up")))
    return path


def find(entities: DataFrame, observations: DataFrame, kind: str, region=None, near: tuple[float, float] | None = None, filters: list[AttrFilter] = (), limit: int = 50) -> DataFrame:
    """Entities of a kind in a region that pass all filters, nearest first, with the number found in all.

    Region and liveness filter before any join; attributes are read only if a filter names them.
    """
    found = entities.where(F.col("kind") == kind)
    if "retired_run_id" in entities.columns:
        found = alive(found)
    if region is not None:
        found = found.where(region.holds(F.col("x"), F.col("y")))
    if filters:
        attrs = sorted({f.attr for f in filters})
        state = wide(observations, attrs)
        for f in filters:
            state = state.where(f.on(F.col(f"`{f.attr}`")))
        found = found.join(state.select("entity_id", *[F.col(f"`{a}`") for a in attrs]), "entity_id")
    d = F.hypot(F.col("x") - near[0], F.col("y") - near[1]) if near else F.lit(None).cast("double")
    found = found.withColumn("distance", d)
    total = found.agg(F.count("*").alias("total"))
    top = found.orderBy(F.col("distance").asc_nulls_last(), "entity_id").limit(max(1, min(1000, limit)))
    return top.join(F.broadcast(total))
