"""Events posted at least once: an outbox with retries, growing delays and dead letters.

Every batch posts what is new and what is due again, from all partitions, and writes the next version of the outbox: events that still wait,
with their attempts and when they are due. A batch that is tried again posts again what it had posted, with the same key, so a receiver that knows keys
takes each event once; nothing is dropped by a full queue or an early stop.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WAITING = "key string, body string, attempts int, due_ms long"


def delay_ms(attempts: Column, first_ms: int, most_ms: int) -> Column:
    """The wait after so many attempts: doubled each time, up to a limit."""
    return F.least(F.lit(float(most_ms)), first_ms * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)).cast("double"))).cast("long")


def post_round(waiting: DataFrame, post: Callable[[str, str], None], now_ms: int, attempts: int, first_ms: int, most_ms: int) -> DataFrame:
    """``waiting`` after one round: ``key, body, attempts, due_ms, state, error``; the due ones have been posted once.

    ``post(key, body)`` raises if it fails. ``state`` is ``sent``, ``waiting`` or, after ``attempts`` failures, ``dead``.
    """

    def send(frames):
        for f in frames:
            errors = []
            for key, body, due in zip(f["key"], f["body"], f["due_ms"] <= now_ms, strict=True):
                try:
                    errors.append(post(key, body) and None if due else "later")
                except Exception as e:  # whatever a receiver does, the event waits
                    errors.append(f"failed: {e}"[:300])
            yield pd.DataFrame({"key": f["key"], "body": f["body"], "attempts": f["attempts"], "due_ms": f["due_ms"], "error": pd.Series(errors, dtype=object, index=f.index)})

    tried = waiting.mapInPandas(send, WAITING + ", error string")
    later, failed = F.coalesce(F.col("error") == "later", F.lit(False)), F.coalesce(F.startswith("error", F.lit("failed")), F.lit(False))
    n = F.when(later, F.col("attempts")).otherwise(F.col("attempts") + 1)
    state = F.when(later, "waiting").when(~failed, "sent").when(n >= attempts, "dead").otherwise("waiting")
    due = F.when(later, F.col("due_ms")).otherwise(now_ms + delay_ms(n, first_ms, most_ms))
    return tried.select("key", "body", n.alias("attempts"), due.alias("due_ms"), state.alias("state"), F.when(failed, F.col("error")).alias("error"))


class Outbox:
    """Versions of the outbox under ``path``: one folder a round, the last whole one counts."""

    def __init__(self, spark: SparkSession, path: str, post: Callable[[str, str], None], attempts: int = 5, first_ms: int = 1000, most_ms: int = 60_000):
        self.spark, self.path, self.post, self.limits = spark, path, post, (attempts, first_ms, most_ms)

    def _rows(self, round_: int) -> DataFrame:
        return self.spark.read.schema(WAITING + ", state string, error string").parquet(f"{self.path}/round={round_}")

    def last(self) -> int:
        """The number of the last round that is written whole, -1 before the first."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return -1
        found = [s.getPath() for s in system.listStatus(root)]
        return max([int(p.getName().split("=")[1]) for p in found if system.exists(hadoop.Path(p, "_SUCCESS"))], default=-1)

    def round(self, new: DataFrame | None, now_ms: int, number: int | None = None) -> None:
        """Posts ``new`` (``key, body``) and what is due; a round that is tried again starts from the one before it."""
        number = self.last() + 1 if number is None else number
        old = self._rows(number - 1).where("state = 'waiting'").drop("state", "error") if number > 0 else None
        fresh = None if new is None else new.select(F.col("key").cast("string").alias("key"), F.col("body").cast("string").alias("body"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("due_ms"))
        rows = old if fresh is None else fresh if old is None else fresh.unionByName(old)
        if rows is not None:
            post_round(rows, self.post, now_ms, *self.limits).write.mode("overwrite").parquet(f"{self.path}/round={number}")

    def history(self) -> DataFrame:
        """All rounds: ``round, key, attempts, state, error``."""
        spec = WAITING + ", state string, error string, round int"
        return self.spark.read.schema(spec).option("basePath", self.path).parquet(f"{self.path}/round=*").select("round", "key", "attempts", "state", "error")


def deliver(stream: DataFrame, outbox: Outbox, checkpoint: str, clock: Callable[[], int]) -> StreamingQuery:
    """Posts a stream of ``key, body``: a round a batch, then stops. Retries of a quiet stream are rounds without new events."""

    def put(batch: DataFrame, n: int) -> None:
        outbox.spark = batch.sparkSession
        # rounds in between have no batch of their own, so a batch knows its round by a note that it leaves
        note = f"{outbox.path}-batches/batch={n}"
        spark = batch.sparkSession
        try:
            number = spark.read.schema("round int").parquet(note).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            number = outbox.last() + 1
            spark.createDataFrame([(number,)], "round int").write.mode("overwrite").parquet(note)
        outbox.round(batch, clock(), number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
