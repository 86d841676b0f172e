"""Session settings, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: UTC throughout, ANSI semantics, adaptive plans with skew handling.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts reach Python in batches that a worker can hold several times over
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}
#: Of these, those that ship() gives a session which the caller has built.
BATCHES = {k: v for k, v in SETTINGS.items() if "PerBatch" in k}


def build(master: str | None = None, app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the package's settings; sizes of shuffles and memory are the caller's."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application, and the session its batch sizes.

    Needed where the package is not installed on them: functions that run in
    Arrow batches are found there by their module's name.
    """
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(here.rglob("*.py")):
            out.write(f, f.relative_to(here.parent))
    context.addPyFile(path)
    context._tessera_shipped = True


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share.

    Without that setting a session on one machine gets a temporary folder; a cluster is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for results that several steps read."""
    spark = df.sparkSession
    path = f"{shared(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least, for costly work on the rows of a few files."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)
