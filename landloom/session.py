"""Tables that cut a lineage, where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of the application, ``landloom-`` and its id, in the one that ``spark.checkpoint.dir`` names; it can be deleted after it.

    Where the setting is missing, a local master uses a temporary folder and a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="landloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/landloom-{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again.

    A table ends the lineage as a checkpoint does, and ends what the optimiser carries along with it, which in loops grows with every
    round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
