"""Tables of the data model, their value domains, and loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in columns])


_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampType()
KNOWLEDGE_BASES = _table(("id", _S, False), ("name", _S, False), ("description", _S, True), ("created_at", _TS, True))
DOCUMENTS = _table(
    ("id", _S, False), ("kb_id", _S, False), ("title", _S, True), ("source", _S, True), ("storage_key", _S, True), ("file_hash", _S, True),
    ("file_hash_sha256", _S, True), ("parse_engine", _S, True), ("chunk_count", _I, True), ("status", _S, False), ("content", _S, True), ("error_msg", _S, True),
    ("error_type", _S, True), ("error_trace", _S, True), ("image_status", _S, True), ("index_status", _S, True), ("page_count", _I, True), ("created_at", _TS, True),
)
DOCUMENT_IMAGES = _table(
    ("id", _S, False), ("doc_id", _S, False), ("kb_id", _S, False), ("storage_key", _S, True), ("filename", _S, True), ("width", _I, True), ("height", _I, True),
    ("alt", _S, True), ("context", _S, True), ("section_title", _S, True), ("description", _S, True), ("vision_status", _S, True), ("image_index", _I, True),
    ("page", _I, True), ("phash", _S, True), ("created_at", _TS, True),
)
TASKS = _table(
    ("id", _S, False), ("task_type", _S, False), ("payload", _S, True), ("status", _S, False), ("priority", _I, True), ("attempts", _I, True), ("max_attempts", _I, True),
    ("error", _S, True), ("created_at", _TS, True), ("started_at", _TS, True), ("finished_at", _TS, True), ("locked_until", _TS, True),
)
CHUNKS = _table(
    ("id", _S, False), ("doc_id", _S, False), ("kb_id", _S, False), ("content", _S, True), ("embedding", T.ArrayType(T.FloatType(), False), True), ("chunk_index", _I, True),
    ("parent_id", _S, True),
)
METRICS = _table(("ts", _TS, False), ("metric", _S, False), ("labels", T.MapType(_S, _S), True), ("value", T.DoubleType(), True))

# The domains of status columns.
DOMAINS = {
    "documents.status": ("queued", "parsing", "indexing", "completed", "failed"),
    "documents.index_status": ("skipped", "pending", "completed", "failed"),
    "documents.image_status": ("none", "pending", "completed"),
    "documents.error_type": ("parse_error", "empty_content", "too_large", "permanent", "image_only"),
    "tasks.status": ("pending", "running", "completed", "dead"),
    "document_images.vision_status": ("pending", "skipped", "completed", "failed"),
}
#: A document with one of these states holds its content hash against newcomers.
LIVE = ("completed", "indexing", "queued", "parsing")


def in_domain(domain: str, column: Column) -> Column:
    return column.isNull() | column.isin(*DOMAINS[domain])


def check_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """chunks as they are; the job fails on an embedding of another length."""
    return chunks.where(F.expr(f"assert_true(embedding IS NULL OR size(embedding) = {dim}, 'embedding has another dimension') IS NULL"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
