"""Streams that fold in event time against their batch twins, for events that arrive in any order."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, state
from tessera.streaming import ordered, windows

FAR = 10_000_000


@pytest.fixture
def stores(spark):
    for k, v in ordered.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in ordered.STORE:
        spark.conf.unset(k)


def _events(seed, n=160):
    """(key, id, second, flag): ties in time, idle stretches, keys of very different sizes."""
    rng = random.Random(seed)
    return [(rng.choice("aaaab") if i % 20 else "c", i, rng.choice([0, 4000]) + rng.randrange(600), rng.random() < 0.7) for i in range(n)]


def _arrive(spark, path, rows, seed):
    """The rows as a stream of three files in random order, then rows of another key that push the watermark on."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    schema = "key string, id long, s long, flag boolean"
    parts = [rows[k::3] for k in range(3)] + [[("end", -1, FAR, False)], [("end", -2, FAR + 9000, False)]]
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).selectExpr("key", "id", "timestamp_seconds(s) AS ts", "flag")
        df.coalesce(1).write.parquet(f"{path}/{k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))
    return source


def _batch(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, s long, flag boolean").selectExpr("key", "id", "s", "timestamp_seconds(s) AS ts", "flag")


def _rows(stream, name):
    return sorted((r.key, r.id, r.verdict) for r in windows.run_to_end(stream, name).collect() if r.key != "end")


@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown(spark, stores, tmp_path, seed):
    rows = _events(seed)
    got = _rows(ordered.cooldown_stream(_arrive(spark, tmp_path, rows, seed).withColumn("blocked", ~F.col("flag")), 60, "2 hours"), f"cooled{seed}")
    twin = state.cooldown(_batch(spark, rows).select(F.col("key").alias("host"), "id", F.col("s").cast("double").alias("ts"), (~F.col("flag")).alias("blocked")), 60)
    assert got == sorted((r.host, r.id, r.cooled) for r in twin.collect()) and {v for _, _, v in got} == {True, False}


def test_limiter(spark, stores, tmp_path):
    rows = _events(3)
    got = _rows(ordered.limiter_stream(_arrive(spark, tmp_path, rows, 3), 3, 60.0, "2 hours"), "limited")
    twin = state.limiter(_batch(spark, rows).select("key", "id", F.col("s").alias("ts")), 3, 60.0)
    assert got == sorted((r.key, r.id, r.allowed) for r in twin.collect()) and {v for _, _, v in got} == {True, False}


def test_hold(spark, stores, tmp_path):
    rows = _events(4)
    got = _rows(ordered.held_stream(_arrive(spark, tmp_path, rows, 4).withColumnRenamed("flag", "firing"), 20, "2 hours"), "held")
    twin = metrics.held(_batch(spark, rows).withColumnRenamed("flag", "firing"), 20, "key")
    assert got == sorted((r.key, r.id, r.alert) for r in twin.collect()) and {v for _, _, v in got} == {True, False}


def test_what_is_kept_goes(spark, stores, tmp_path):
    """400 hosts blocked once: when their time has passed, nothing of them is in the state."""
    rows = [(f"h{i}", i, i, False) for i in range(400)]
    blocked = ordered.cooldown_stream(_arrive(spark, tmp_path / "in", rows, 5).withColumn("blocked", ~F.col("flag")), 60, "1 hour")
    query = blocked.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    assert sum(h["numRegisteredTimers"] for h in held) >= 800  # for each host one to fold and one to forget
    left = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "state"))
    assert {r.key[0] for r in left.select("key").collect()} <= {"end"}


def test_ended_and_nulls(spark, stores, tmp_path):
    """One batch and its end; a null key is a key, a null flag is false, an event without a time goes."""
    rows = [("a", 1, 5, True), ("a", 2, 6, None), (None, 3, 7, True), (None, 4, 8, False), ("a", 5, None, True), ("a", None, 9, False)]
    df = spark.createDataFrame(rows, "key string, id long, s long, blocked boolean").selectExpr("key", "id", "timestamp_seconds(s) AS ts", "blocked")
    df.write.parquet(str(tmp_path / "in"))
    stream = ordered.ended(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    got = windows.run_to_table(ordered.cooldown_stream(stream, 60, "0 seconds"))
    assert sorted(((r.key, r.id, r.verdict) for r in got.collect()), key=str) == sorted([("a", 1, False), ("a", 2, True), ("a", -1, True), (None, 3, False), (None, 4, True)], key=str)
