"""Ingest: gates, content-hash dedup, outcome of parsing, storage of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sha256, strip, text_title
from tessera.schema import LIVE

MIN_CONTENT, MAX_CONTENT = 50, 5_000_000


def text_source(texts: DataFrame) -> DataFrame:
    """Text documents from (kb_id, text, title): title and both hashes set, queued."""
    return texts.select(
        "*", text_title(F.col("text"), F.col("title")).alias("doc_title"), sha256(F.col("text")).alias("file_hash_sha256"), F.lit("queued").alias("status"),
    )


def existing(new: DataFrame, documents: DataFrame, legacy: bool = True) -> DataFrame:
    """new (kb_id, sha, md5) with the id of the live document of the same content in the same kb.

    The newest SHA-256 hit wins; only without one the newest MD5 hit counts.
    Failed documents hold nothing.
    """
    live = documents.where(F.col("status").isin(*LIVE))

    def newest(hash_: str, name: str) -> DataFrame:
        found = live.where(F.col(hash_).isNotNull()).groupBy("kb_id", F.col(hash_).alias(name)).agg(F.max(F.struct("created_at", "id")).alias("hit"))
        return found.select("kb_id", name, F.col("hit.id").alias(f"by_{name}"))

    out = new.join(newest("file_hash_sha256", "sha"), ["kb_id", "sha"], "left")
    if not legacy:
        return out.withColumn("existing_id", F.col("by_sha")).drop("by_sha")
    out = out.join(newest("file_hash", "md5"), ["kb_id", "md5"], "left")
    return out.withColumn("existing_id", F.coalesce("by_sha", "by_md5")).drop("by_sha", "by_md5")


def first_of_content(docs: DataFrame) -> DataFrame:
    """Of a batch (doc_id, kb_id, content): the first document of each content and kb; null content is no content."""
    hashed = docs.withColumn("sha", sha256(F.col("content")))
    first = hashed.where("sha IS NOT NULL").groupBy("kb_id", "sha").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies"))
    return hashed.join(first, ["kb_id", "sha"], "left")


def useful(content: Column, allow_image_only: Column, images: Column) -> Column:
    return (F.length(strip(F.coalesce(content, F.lit("")))) >= MIN_CONTENT) | (F.coalesce(allow_image_only, F.lit(False)) & (F.coalesce(images, F.lit(0)) > 0))


def outcome(attempts: DataFrame, indexing: bool = True, index_failed: Column | None = None) -> DataFrame:
    """What becomes of each document, from its parse attempts in order.

    attempts: doc_id, status, attempt, content, images, allow_image_only and
    error ('' or null: none, 'permanent': no retry, else a message). Attempts
    count up to the first useful result or permanent error.
    """
    ok = useful(F.col("content"), F.col("allow_image_only"), F.col("images")) & (F.coalesce("error", F.lit("")) == "")
    ends = ok | (F.coalesce("error", F.lit("")) == "permanent")
    w = Window.partitionBy("doc_id")
    marked = attempts.withColumn("ok", ok).withColumn("stop", F.min(F.when(ends, F.col("attempt"))).over(w))
    last = marked.where(F.col("stop").isNull() | (F.col("attempt") <= F.col("stop")))
    last = last.groupBy("doc_id").agg(F.max(F.struct("attempt", "ok", "content", "images", "allow_image_only", "error", "status")).alias("x")).select("doc_id", "x.*")
    length = F.length("content")
    error, failed = F.coalesce("error", F.lit("")), F.coalesce(index_failed, F.lit(False)) if index_failed is not None else F.lit(False)
    kind = (
        F.when(F.col("status").isin("completed", "indexing"), "skip")
        .when(error == "permanent", "permanent").when(~F.col("ok") & (error == ""), "empty_content").when(~F.col("ok"), "parse_error")
        .when((F.length(strip(F.coalesce("content", F.lit("")))) < MIN_CONTENT), "image_only").when(length > MAX_CONTENT, "too_large")
        .when(F.lit(not indexing), "stored").when(failed, "index_failed").otherwise("completed")
    )
    out = last.withColumn("kind", kind)
    return out.select(
        "doc_id",
        F.when(F.col("kind") == "skip", F.col("status")).when(F.col("kind").isin("permanent", "empty_content", "parse_error", "too_large"), "failed").otherwise("completed").alias("new_status"),
        F.when(F.col("kind") == "skip", F.lit(None)).when(F.col("kind").isin("image_only", "too_large", "stored"), "skipped").when(F.col("kind") == "index_failed", "failed").when(F.col("kind") == "completed", "completed").otherwise("pending").alias("index_status"),
        F.when(F.col("kind").isin("permanent", "empty_content", "parse_error", "image_only", "too_large"), F.col("kind")).alias("error_type"),
        F.when(F.col("kind") == "parse_error", F.substring("error", 1, 500)).alias("error_msg"),
        F.col("kind").isin("parse_error", "index_failed").alias("raises"),
    )


def known_kbs(requests: DataFrame, kbs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests whose knowledge base exists, and the others with the status that answers them; a null one exists nowhere."""
    ids = kbs.select("kb_id").distinct()
    missing = requests.join(ids, "kb_id", "left_anti").withColumns({"status_code": F.lit(404), "error": F.lit("KnowledgeBase not found")})
    return requests.join(ids, "kb_id", "left_semi"), missing


def upsert(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks after an insert that updates on equal id: content, embedding, index and parent change, doc_id and kb_id stay."""
    changed = ["content", "embedding", "chunk_index", "parent_id"]
    fresh = new.groupBy("id").agg(F.max(F.struct("seq", *[c for c in new.columns if c not in ("id", "seq")])).alias("n")) if "seq" in new.columns else new.select("id", F.struct(*[c for c in new.columns if c != "id"]).alias("n"))
    both = chunks.alias("o").join(fresh.alias("f"), "id", "full_outer")
    pick = lambda c: F.when(F.col("f.n").isNotNull(), F.col(f"f.n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"f.n.{c}")).alias(c)
    return both.select("id", keep("doc_id"), keep("kb_id"), *[pick(c) for c in changed])


def delete_by(chunks: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return chunks.join(keys.select(column).distinct(), column, "left_anti")


def get_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of these ids with score 1.0."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi").withColumn("score", F.lit(1.0))


def cascade(deleted_kbs: DataFrame, documents: DataFrame, images: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, images and chunks that are left when knowledge bases go; chunks are deleted by their own kb_id."""
    docs = documents.join(deleted_kbs, "kb_id", "left_anti")
    gone = documents.join(deleted_kbs, "kb_id", "left_semi").select(F.col("id").alias("doc_id"))
    return docs, images.join(gone, "doc_id", "left_anti"), chunks.join(deleted_kbs, "kb_id", "left_anti")


def enqueue(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents to queue and their parse tasks, from one frame (id, kb_id, source, parse_engine, created_at)."""
    queued = docs.withColumn("status", F.lit("queued"))
    tasks = queued.select(
        F.concat(F.lit("task-"), "id").alias("id"), F.lit("parse_document").alias("task_type"), F.to_json(F.struct(F.col("id").alias("doc_id"), "source", F.col("parse_engine").alias("engine"))).alias("payload"),
        F.lit("pending").alias("status"), F.lit(0).alias("priority"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), "created_at",
    )
    return queued, tasks
