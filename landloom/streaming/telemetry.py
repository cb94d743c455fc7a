"""Telemetry as Structured Streaming: validated intake, latest state, windows and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landloom.operators import telemetry as T

RAW = "id long, device_id string, kind string, observed_at string, lat double, lon double, label string, gateway_id string"


def events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines dropped into a folder, with ``observed_ms`` and ``problem``; a batch takes so many files at most."""
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(path)
    return T.validate(raw.withColumn("observed_ms", T.parse_time(F.col("observed_at"))))


def store(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sound events to Parquet by day, the others to a dead-letter folder; all that is there, then stop."""

    def put(batch: DataFrame, n: int) -> None:
        batch = batch.withColumn("batch", F.lit(n))
        for part, to in ((batch.where("problem is null").drop("problem"), "events"), (batch.where("problem is not null"), "dead")):
            day = F.to_date(F.timestamp_millis("observed_ms"))
            # a batch that is tried again replaces its own files
            part.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{path}/{to}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The latest state per device, in arrival order, as one table version per batch under ``path``.

    A batch folds into the version before it; trying a batch again writes the same version anew.
    """

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fields = ["device_id", "id", "kind", "observed_ms", "gateway_id", "lat", "lon", "position_ms", "label"]
        new = batch.where("problem is null").withColumn("position_ms", F.when(F.col("lat").isNotNull(), F.col("observed_ms"))).select(fields)
        if n > 0:
            new = new.unionByName(spark.read.parquet(f"{path}/version={n - 1}").select(fields))
        fix, named = F.col("lat").isNotNull(), F.col("label").isNotNull()
        at = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("id"))).alias(c)
        last = [F.max_by(c, "id").alias(c) for c in ("kind", "observed_ms", "gateway_id")]
        new.groupBy("device_id").agg(F.max("id").alias("id"), *last, at("lat", fix), at("lon", fix), at("position_ms", fix), at("label", named)).write.mode("overwrite").parquet(f"{path}/version={n}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per kind and window of event time; what comes later than ``late`` is left out."""
    timed = stream.where("problem is null").withColumn("at", F.timestamp_millis("observed_ms")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width, slide), "kind").agg(F.count("*").alias("n"), F.approx_count_distinct("device_id").alias("devices"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each device that end after a gap."""
    timed = stream.where("problem is null").withColumn("at", F.timestamp_millis("observed_ms")).withWatermark("at", late)
    return timed.groupBy("device_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))


def unique(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return stream.withColumn("at", F.timestamp_millis("observed_ms")).withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
