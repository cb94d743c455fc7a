"""The operation journal: gzip JSON lines in numbered files, replayed into the store's tables.

Order is file name, then line. Every table is a fold of its operations by key, the last writer winning, so replay is a
handful of grouped aggregates over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = """op string, run_id long, script string, started_at string, finished_at string, inputs_hash string, notes string, key string, value string,
  entity_id string, kind string, created_at string, retired_at string, attr string, at string, source string, confidence double, layer string, x double, y double,
  wkb string, properties string, layer_id string, fields string, name string, geom_type string, plan_id string, revision_id string, parent_revision_id string, base_id string, content_hash string, status string, plan_run_id string"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """All operations with ``seq``, their place in the journal. A gzip file is read by one task, so its lines keep their order."""
    lines = spark.read.schema(OPS).json(path).select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    return lines.withColumn("seq", F.struct("file", "line")).drop("file", "line")


def append(ops: DataFrame, path: str, slug: str) -> str:
    """Write a batch of operations as the next numbered part of the journal; readers see it whole or not at all."""
    spark = ops.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    number = 1 + max([int(n[:6]) for n in taken if n[:6].isdigit()], default=0)
    staged = f"{path}/_staged-{number:06d}"
    ops.coalesce(1).write.option("compression", "gzip").json(staged)
    part = next(s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(staged)) if s.getPath().getName().startswith("part-"))
    final = f"{path}/{number:06d}-{slug}.jsonl.gz"
    if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(final)):
        raise OSError(f"{final} is taken")
    fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
    return final


def _last(*columns: str) -> Column:
    return F.max_by(F.struct(*columns), "seq").alias("v")


def replay(ops: DataFrame) -> dict[str, DataFrame]:
    """The tables that a journal describes: runs, meta, entities, observations, points, features, layers, plans, revisions."""
    of = lambda *names: ops.where(F.col("op").isin(*names))
    runs = of("run", "finish_run").groupBy("run_id").agg(
        F.max_by(F.when(F.col("op") == "run", F.struct("script", "started_at", "inputs_hash")), F.when(F.col("op") == "run", F.col("seq"))).alias("r"),
        F.max_by(F.when(F.col("op") == "finish_run", F.col("finished_at")), F.when(F.col("op") == "finish_run", F.col("seq"))).alias("finished_at"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("seq"))).alias("notes"),
    )
    born = F.col("op") == "entity"
    change = F.col("op").isin("retire", "unretire")
    entities = of("entity", "retire", "unretire").groupBy("entity_id").agg(
        F.min_by(F.when(born, F.struct("kind", F.col("run_id").alias("created_run_id"), "created_at")), F.when(born, F.col("seq"))).alias("e"),
        F.max_by(F.when(change, F.when(F.col("op") == "retire", F.struct(F.col("run_id").alias("retired_run_id"), "retired_at"))), F.when(change, F.col("seq"))).alias("g"),
    )
    # numbering all observations in order: offsets of the parts from their counts, then places within a part
    obs = of("obs")
    keyed = {
        "meta": ("meta", ["key"], ["value"]), "points": ("point", ["layer", "entity_id"], ["source", "x", "y"]), "layers": ("layer", ["layer_id"], ["fields"]), "spatial_layers": ("spatial_layer", ["name"], ["geom_type"]),
        "plan_bases": ("plan_base", ["base_id"], ["content_hash", "created_at"]), "revisions": ("plan_revision", ["revision_id"], ["plan_id", "parent_revision_id", "base_id", "content_hash"]),
        "heads": ("plan_head", ["plan_id"], ["revision_id"]), "simulations": ("plan_simulation", ["plan_run_id"], ["revision_id", "status"]),
    }
    found = {name: of(op).groupBy(*k).agg(_last(*v)).select(*k, "v.*") for name, (op, k, v) in keyed.items()}
    found["features"] = of("feature", "feature_upsert").groupBy("layer", "entity_id").agg(_last("wkb", "properties")).select("layer", "entity_id", "v.*")
    found["plans"] = of("plan_create", "plan_update").groupBy("plan_id").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"), F.min_by("created_at", "seq").alias("created_at"))
    return found | {
        "runs": runs.select("run_id", "r.*", "finished_at", "notes"),
        "entities": entities.select("entity_id", "e.*", "g.*"),
        "observations": obs.select("seq", "entity_id", "attr", "value", F.col("at").alias("observed_at"), "run_id", "source", "confidence"),
    }
