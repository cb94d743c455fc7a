"""Delivery under injected failures: every event arrives, a sink that knows keys takes it once, hopeless ones are dead letters."""

import json
import os

import pytest
from pyspark.sql import functions as F

from landloom.streaming import poster


def receiver(folder, flaky):
    """A post function that counts attempts in files, which all workers see, and fails the first ``flaky[key]`` times."""

    def post(key, body):
        tries = os.path.join(folder, key + ".tries")
        n = os.path.getsize(tries) if os.path.exists(tries) else 0
        with open(tries, "a") as f:
            f.write("x")
        if n < flaky.get(key, 0):
            raise OSError("no route")
        with open(os.path.join(folder, key + ".got"), "a") as f:
            f.write(body + "\n")

    return post


def test_retries_reach_everything(spark, tmp_path):
    sink, log, path, mark = (str(tmp_path / n) for n in ("sink", "log", "out", "mark"))
    os.makedirs(sink), os.makedirs(log)
    flaky = {"b": 1, "c": 3, "d": 99}
    box = poster.Outbox(spark, path, receiver(sink, flaky), attempts=4, first_ms=100, most_ms=250)
    now = [1000]

    def write(name, *keys):
        (tmp_path / "log" / name).write_text("\n".join(json.dumps({"key": k, "body": f"event {k}"}) for k in keys))

    def run():
        stream = spark.readStream.schema("key string, body string").option("maxFilesPerTrigger", 1).json(log)
        poster.deliver(stream, box, mark, lambda: now[0]).awaitTermination(120)

    write("1.json", "a", "b", "c", "d")
    run()
    assert {r.key: r.state for r in box.history().collect()} == {"a": "sent", "b": "waiting", "c": "waiting", "d": "waiting"}
    box.round(None, now[0] + 50)  # too early for all
    assert {r.key: r.attempts for r in box.history().where("round = 1").collect()} == {"b": 1, "c": 1, "d": 1}
    now[0] += 100
    write("2.json", "e")
    run()
    assert {r.key: (r.state, r.attempts) for r in box.history().where("round = 2").collect()} == {"e": ("sent", 1), "b": ("sent", 2), "c": ("waiting", 2), "d": ("waiting", 2)}
    for wait in (200, 250, 250):
        now[0] += wait
        box.round(None, now[0])
    last = {r.key: (r.state, r.attempts, r.error) for r in box.history().orderBy("round").collect()}
    assert last == {"a": ("sent", 1, None), "b": ("sent", 2, None), "c": ("sent", 4, None), "d": ("dead", 4, "failed: no route"), "e": ("sent", 1, None)}
    assert sorted(f for f in os.listdir(sink) if f.endswith(".got")) == [f"{k}.got" for k in "abce"]
    assert all(open(f"{sink}/{k}.got").read() == f"event {k}\n" for k in "abce") and os.path.getsize(f"{sink}/d.tries") == 4


def test_a_round_that_dies_is_posted_again_with_the_same_keys(spark, tmp_path):
    sink, path = str(tmp_path / "sink"), str(tmp_path / "out")
    os.makedirs(sink)
    box = poster.Outbox(spark, path, receiver(sink, {}), attempts=2)
    new = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, body string")
    dying = new.union(spark.range(1).select(F.lit("c").alias("key"), F.raise_error(F.lit("executor lost")).cast("string").alias("body")))
    with pytest.raises(Exception, match="executor lost"):
        box.round(dying, 0)
    assert box.last() == -1
    box.round(new, 0)
    got = {f[0]: set(open(f"{sink}/{f}")) for f in os.listdir(sink) if f.endswith(".got")}
    assert got == {"a": {"x\n"}, "b": {"y\n"}} and box.last() == 0
    box.round(None, 10**9)
    assert box.history().where("round = 1").count() == 0


def test_delays_double_up_to_a_limit(spark):
    got = spark.range(1, 9).select(poster.delay_ms(F.col("id"), 500, 20_000).alias("d")).collect()
    assert [r.d for r in got] == [500, 1000, 2000, 4000, 8000, 16_000, 20_000, 20_000]
