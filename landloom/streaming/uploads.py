"""An upload log read past a cursor: every upload is taken in once, also when a run dies in between.

The log is a folder of JSON lines. What has been read is the checkpoint of the stream, committed with each batch; a batch that is tried again
writes the same folders anew, so a rerun adds nothing and a run that was stopped goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landloom.operators.survey import classify

UPLOAD = "upload string, id string, x double, y double, status string, name string, broken string"


def store_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The latest state of every feature: ``id, x, y, status, name`` and the ``batch`` that brought it, of batches ``before`` one."""
    spec = "id string, x double, y double, status string, name string, batch long"
    try:
        rows = spark.read.schema(spec).parquet(f"{path}/features")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], spec)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("id").agg(F.max_by(F.struct("x", "y", "status", "name", "batch"), "batch").alias("r")).select("id", "r.*")


def ingest_uploads(spark: SparkSession, log: str, path: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Takes in all lines of ``log`` that no run has read, then stops; under ``path`` are ``features``, ``changes`` and ``bad`` lines, by batch.

    Lines that are no JSON or have no ``id`` go to ``bad`` and move the cursor, too.
    """
    stream = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", files_per_batch).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(log)

    def put(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()
        sound = batch.where("broken is null and id is not null")
        # the state before this batch, whether or not an earlier try has written it
        before = store_state(session, path, n).drop("batch")
        found = classify(sound, before, ["name"])
        out = found.where(~F.col("change").isin("absent", "unchanged"))
        fresh = sound.groupBy("id").agg(F.max(F.struct("x", "y", "status", "name")).alias("r")).select("id", "r.*").join(out.select("id"), "id")
        merged = fresh.join(before.select("id", F.col("name").alias("old")), "id", "left").withColumn("name", F.coalesce("name", "old")).drop("old")
        out.write.mode("overwrite").parquet(f"{path}/changes/batch={n}")
        batch.where("broken is not null or id is null").select("broken", "upload").write.mode("overwrite").parquet(f"{path}/bad/batch={n}")
        merged.write.mode("overwrite").parquet(f"{path}/features/batch={n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
