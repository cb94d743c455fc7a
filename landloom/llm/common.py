"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Stands for a null id inside joins and comparisons: it sorts below every other id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder; a cluster is refused,
    because no machine-local folder would do there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="landloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The lineage ends there, so that a lost executor costs a reread and an iterative plan stays short.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables in the shared folder that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables of one operator, in a folder of their own under the shared one; deleted at the end of the block."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.count, self.places = spark, shared_path(spark, label), 0, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        forget(self.spark, self.path)

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written and read again."""
        self.count += 1
        path = f"{self.path}/{self.count}-{label}"
        df.write.parquet(path)
        done = self.spark.read.schema(df.schema).parquet(path)
        self.places[id(done)] = done, path
        return done

    def drop(self, table: DataFrame) -> None:
        """Delete a table of this block before its end."""
        forget(self.spark, self.places.pop(id(table))[1])


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within the block, Python functions get at most so many rows at a time: a batch of whole texts stands in the JVM and in Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. A pure ASCII value takes the faster built-in, which agrees there."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER)
    )


def unit_hash(*cols: Column) -> Column:
    """A double in [0, 1) that depends on the given columns only."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(2**53 - 1)).cast("double") / F.lit(float(2**53))
