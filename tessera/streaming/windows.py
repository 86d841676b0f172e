"""Streaming twins of the windowed and sequential operators.

They give on a stream what the batch operators give on the same rows; tests
hold one against the other. Event times must be timestamps with a zone.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.state import Breaker
from tessera.session import shared


def event_stream(spark: SparkSession, path: str, glob: str = "events.parquet", files: int = 1) -> DataFrame:
    """The events of a folder as a stream; ts becomes a timestamp in the session's zone, as watermarks ask."""
    schema = spark.read.parquet(f"{path}/{glob}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_ratio(events: DataFrame, bad: Column, size: str, step: str, late: str = "10 minutes", *by: str) -> DataFrame:
    """Sliding counts and bad counts by window, late rows accepted up to the watermark."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), *by)
    return grouped.agg(F.count("*").alias("total"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad")).select(F.col("window.start").alias("start"), *by, "total", "bad")


def hourly(events: DataFrame, late: str = "1 hour", *by: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), *by, "n")


def breaker_stream(calls: DataFrame, failures: int = 5, reset_s: float = 60.0) -> DataFrame:
    """The breaker with its state kept between micro-batches; rows of a batch are taken in time order."""

    def fold(key, frames, state: GroupState):
        b = Breaker(failures, reset_s, *(state.get if state.exists else ("closed", 0, 0.0)))
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "id"])
            rows = [(key[0], r.id, *b.step(r.ts, r.ok, r.counted)) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["name", "id", "verdict", "state"])
        state.update((b.state, b.row, b.opened))

    return calls.groupBy("name").applyInPandasWithState(fold, "name string, id long, verdict string, state string", "state string, row int, opened double", "append", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through a memory sink; for tests and small jobs."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, **settings: str) -> DataFrame:
    """All that is there now, as a table in the shared folder that executors write; the settings hold while it runs."""
    spark = df.sparkSession
    path = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(f"{path}/rows")
