import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def _canonical(frame):
    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 9))
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19]
        return str(v)

    frame = frame.astype(object).where(frame.notna(), None)
    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same_as_sql(spark, data):
    """Compare a query with its SQL in DuckDB over the same tables."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(data)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")

    def compare(query, sql):
        got, want = _canonical(query(spark, data).toPandas()), _canonical(con.execute(sql).df())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]

    return compare
