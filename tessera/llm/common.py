"""Shared by the operators: tables written between phases, and table loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the session runs on one machine, as in tests, a
    temporary folder is set; a cluster without a shared folder is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


#: Rows of an Arrow batch of texts. Spark's default of 10,000 makes a Python
#: worker hold tens of MB of text several times over. tessera.session sets it.
BATCH_ROWS = 1000
#: Bytes of such a batch: long texts, and sets of them in pairs, come in fewer rows.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside deal texts in batches of at most BATCH_ROWS rows and BATCH_BYTES; the settings are put back."""
    rows, size = spark.conf.get(_BATCH), spark.conf.get(_BYTES)
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)
    if int(rows) <= 0 or int(rows) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(_BATCH, rows)
        spark.conf.set(_BYTES, size)


def map_texts(df: DataFrame, work: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow(work). The caller's session decides the batches of a lazy result; see text_batches."""
    return df.mapInArrow(work, schema)


class Workspace:
    """Tables written in the shared folder between the phases of one operator.

    Results that are still read lazily need them; ``clean`` deletes those of all
    operators of this driver when their results have been written or collected.
    """

    roots: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace.roots.append(self.root)

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write df as a table and return it as read back: its lineage ends here, its shuffle files go."""
        path = f"{self.root}/{table}"
        with cleanup_after(self.spark), text_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Delete tables that no later phase reads."""
        for table in tables:
            _delete(self.spark, f"{self.root}/{table}")

    @classmethod
    def clean(cls, spark: SparkSession) -> None:
        """Delete the tables of all operators so far: lazy results of theirs can't be read any more."""
        while cls.roots:
            _delete(spark, cls.roots.pop())


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleanup_after(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside are deleted when each query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
