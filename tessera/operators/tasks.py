"""Task queue transitions, retry of failed documents, and the digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.media import fallback_chain, select_engine
from tessera.functions.text import first_truthy, shortened

CLAIM_MINUTES, BACKOFF_S, BACKOFF_MOST_S = 5, 30, 600
MAX_AGE_HOURS, LOCKOUT_MINUTES, MAX_DEAD, RETRY_LIMIT = 168, 60, 2, 50


def minutes(now: Column, n) -> Column:
    return now + F.make_dt_interval(mins=n if isinstance(n, Column) else F.lit(n))


def eligible(now: Column, task_type: str | None = None) -> Column:
    """Pending tasks whose lock is over or was never set, and running ones whose claim ran out."""
    free = F.col("locked_until").isNull() | (F.col("locked_until") < now)
    out = (F.col("status") == "pending") & free | (F.col("status") == "running") & (F.col("locked_until") < now)
    return out if task_type is None else out & (F.col("task_type") == task_type)


def dequeue(tasks: DataFrame, now: Column, n: int = 1, task_type: str | None = None) -> DataFrame:
    """The n tasks to claim, as they are after the claim: highest priority, then oldest, then id."""
    head = tasks.where(F.coalesce(eligible(now, task_type), F.lit(False))).orderBy(F.col("priority").desc(), "created_at", "id").limit(n)
    return head.withColumns({"status": F.lit("running"), "started_at": now, "locked_until": minutes(now, CLAIM_MINUTES), "attempts": F.col("attempts") + 1})


def complete(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.withColumns({"status": F.lit("completed"), "finished_at": now, "error": F.lit("")})


def backoff(attempts: Column) -> Column:
    """Seconds to wait after so many attempts: doubling, to a most."""
    return F.least(F.lit(BACKOFF_S) * F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(1)) - 1, F.lit(20))), F.lit(BACKOFF_MOST_S)).cast("long")


def fail(tasks: DataFrame, now: Column) -> DataFrame:
    """After a failure: dead once attempts are used up, else pending behind a growing lock."""
    dead = F.col("attempts") >= F.col("max_attempts")
    return tasks.withColumns({
        "status": F.when(dead, "dead").otherwise("pending"),
        "finished_at": F.when(dead, now).otherwise(F.col("finished_at")),
        "locked_until": F.when(dead, F.col("locked_until")).otherwise(now + F.make_dt_interval(secs=backoff(F.col("attempts")))),
    })


def reap(tasks: DataFrame, now: Column) -> DataFrame:
    """Running tasks whose claim ran out with no attempt left become dead."""
    lost = F.coalesce((F.col("status") == "running") & (F.col("locked_until") < now) & (F.col("attempts") >= F.col("max_attempts")), F.lit(False))
    return tasks.withColumns({"finished_at": F.when(lost, now).otherwise(F.col("finished_at")), "status": F.when(lost, "dead").otherwise(F.col("status"))})


def depth(tasks: DataFrame, now: Column) -> DataFrame:
    """Pending tasks by type and the age of the oldest in seconds, never below 0."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.min("created_at").cast("timestamp"))
    return tasks.where("status = 'pending'").groupBy("task_type").agg(F.count("*").alias("depth"), F.greatest(age, F.lit(0)).alias("oldest_s"))


def dead_since(tasks: DataFrame, floor: Column) -> DataFrame:
    """Dead tasks that finished after a time, labelled by the first of source, file name and storage key."""
    at = lambda k: F.get_json_object("payload", f"$.{k}")
    return tasks.where((F.col("status") == "dead") & (F.col("finished_at") > floor)).select("id", "task_type", shortened(first_truthy(at("source"), at("filename"), at("storage_key"))).alias("label"))


def retry_eligible(documents: DataFrame, tasks: DataFrame, now: Column, limit: int | None = RETRY_LIMIT) -> DataFrame:
    """Failed documents to parse again: recent, nothing in flight or just tried, few dead tasks; newest first.

    A left anti join and a count by document, both on the id in the payload.
    """
    parse = tasks.where("task_type = 'parse_document'").withColumn("doc_id", F.get_json_object("payload", "$.doc_id"))
    floor = minutes(now, -60 * MAX_AGE_HOURS)
    busy = parse.where(F.col("status").isin("pending", "running") | (F.col("created_at") > minutes(now, -LOCKOUT_MINUTES))).select(F.col("doc_id").alias("id"))
    dead = parse.where((F.col("status") == "dead") & (F.col("created_at") > floor)).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("dead"))
    failed = documents.where((F.col("status") == "failed") & (F.col("error_type") == "parse_error") & (F.col("created_at") > floor))
    left = failed.join(busy, "id", "left_anti").join(dead, "id", "left").where(F.coalesce("dead", F.lit(0)) < MAX_DEAD).drop("dead")
    ordered = left.orderBy(F.col("created_at").desc(), "id")
    return ordered if limit is None else ordered.limit(limit)


def retry_apply(docs: DataFrame, available: Column) -> DataFrame:
    """Eligible documents as they are queued again: today's engine, payload, errors cleared."""
    is_url = F.coalesce("storage_key", F.lit("")) == ""
    name = F.when(is_url, F.lit("")).otherwise(F.col("source"))
    engine = F.when(is_url, F.lit("url")).otherwise(select_engine(name, available))
    out = docs.withColumn("parse_engine", engine)
    payload = F.to_json(F.struct(F.col("id").alias("doc_id"), "source", F.col("parse_engine").alias("engine")))
    return out.withColumns({"status": F.lit("queued"), "error_type": F.lit(None).cast("string"), "error_msg": F.lit(""), "payload": payload})


def backfill_index_status(documents: DataFrame) -> DataFrame:
    """index_status of old rows: four cases that exclude each other."""
    indexed = F.col("status") == "completed"
    return documents.withColumn(
        "index_status",
        F.when(F.col("error_type").isin("image_only", "too_large"), "skipped").when((F.col("status") == "failed") & F.col("error_type").eqNullSafe("indexing_error"), "failed")
        .when(indexed & ~F.col("error_type").eqNullSafe("indexing_error"), "completed").otherwise("pending"),
    )


def source_kind(storage_key: Column) -> Column:
    """'file' iff there is a storage key that is not empty."""
    return F.when(F.coalesce(storage_key, F.lit("")) != "", "file").otherwise("url")


def digest(documents: DataFrame, cutoff: Column) -> dict[str, DataFrame]:
    """The digest's five aggregates over documents since the cutoff."""
    recent = documents.where(F.col("created_at") >= cutoff)
    failed = recent.where("status = 'failed'")
    return {
        "total": failed.agg(F.count("*").alias("failed")),
        "by_kind": recent.groupBy(source_kind(F.col("storage_key")).alias("kind")).agg(F.count("*").alias("total"), F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed")),
        "by_type": failed.groupBy("error_type").agg(F.count("*").alias("failed")).withColumn("error_type", F.coalesce("error_type", F.lit("unclassified"))),
        "by_engine": failed.groupBy(F.coalesce(F.nullif("parse_engine", F.lit("")), F.lit("unknown")).alias("engine")).agg(F.count("*").alias("failed")),
        "samples": failed.orderBy(F.col("created_at").desc(), "id").limit(10).select(
            "id", F.left("source", F.lit(80)).alias("source"), F.left("error_msg", F.lit(120)).alias("error"), "created_at",
            F.coalesce("error_type", F.lit("unclassified")).alias("error_type"), F.coalesce(F.nullif("parse_engine", F.lit("")), F.lit("unknown")).alias("engine"), shortened(first_truthy(F.col("source"), F.lit("(empty)")), 80).alias("label"),
        ),
    }


# Marks of error types and labels of source kinds in the digest's text.
TYPE_MARKS = {"parse_error": "⚠️", "empty_content": "📭", "image_only": "🖼️", "too_large": "📦", "indexing_error": "💾", "url_fetch_error": "🔗", "permanent": "🚫", "unclassified": "❓"}
OTHER_MARK = "•"
KIND_LABELS = {"file": "📄 文件", "url": "🔗 链接"}


def _mark(error_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_MARKS.items() for x in kv]), error_type), F.lit(OTHER_MARK))


def _listed(counts: DataFrame, name: str, out: str, shown: Callable[[Column], Column]) -> DataFrame:
    """One row: the counts as name×n, most first; null if there are none."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("failed")).alias("n"), F.col(name).alias("name"))))
    text = F.array_join(F.transform(rows, lambda x: F.concat(shown(x["name"]), F.lit("×"), (-x["n"]).cast("string"))), "  ")
    return counts.agg(F.nullif(text, F.lit("")).alias(out))


def digest_text(parts: dict[str, DataFrame], hours: int, env: str = "") -> DataFrame:
    """(text): the digest as a message: a line for each kind of source, then, if there were failures, types, engines and samples.

    Without any document since the cutoff it is one line. Every part is an aggregate of a few rows.
    """
    failed, total = F.col("failed"), F.col("total")
    share = F.rint((total - failed) / total * 100).cast("long").cast("string")
    result = F.when(failed == 0, F.lit(" 个 ✅ 全部成功")).otherwise(F.concat(F.lit(" 个（失败 "), failed.cast("string"), F.lit("，成功率 "), share, F.lit("%）")))
    lines = [F.max(F.when(F.col("kind") == k, F.concat(F.lit(f"{label} "), total.cast("string"), result))).alias(k) for k, label in KIND_LABELS.items()]
    kinds = parts["by_kind"].agg(F.sum("total").alias("all"), *lines)
    types = _listed(parts["by_type"], "error_type", "types", lambda x: F.concat(_mark(x), F.lit(" "), x))
    engines = _listed(parts["by_engine"], "engine", "engines", lambda x: x)
    sample = F.concat(_mark(F.col("error_type")), F.lit(" ["), "engine", F.lit("] "), "label", F.lit("\n   "), F.coalesce("error", F.lit("")))
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "id", sample.alias("s"))))
    samples = parts["samples"].agg(F.transform(newest, lambda x: x["s"]).alias("s"))
    head = (f"[{env}] " if env else "") + f"过去 {hours} 小时入库样本"
    failures = F.when(
        F.col("types").isNotNull(),
        F.concat_ws("\n", F.lit(""), F.concat(F.lit("按类型："), "types"), F.concat(F.lit("按引擎："), "engines"), F.lit(""), F.concat(F.lit("最近 "), F.size("s").cast("string"), F.lit(" 个样本：")), F.array_join("s", "\n")),
    )
    one = kinds.crossJoin(types).crossJoin(engines).crossJoin(samples)
    return one.select(F.when(F.col("all").isNull(), F.lit(f"{head}：0（无新增）")).otherwise(F.concat_ws("\n", F.lit(head), *KIND_LABELS, failures)).alias("text"))


def dashboard(documents: DataFrame) -> dict[str, DataFrame]:
    """Panels of the failure dashboard."""
    failed = documents.where("status = 'failed'")
    domain = F.regexp_extract("source", "^(?:https?://)?([^/]+)", 1)
    return {
        "success_rate": documents.where("status IN ('completed', 'failed')").agg(F.round(F.try_divide(F.count_if(F.col("status") == "completed"), F.count("*")), 6).alias("rate")),
        "by_hour": failed.groupBy(F.date_trunc("HOUR", "created_at").alias("hour"), "error_type").agg(F.count("*").alias("failed")),
        "domains": failed.groupBy(domain.alias("domain")).agg(F.count("*").alias("failed")).orderBy(F.col("failed").desc(), "domain").limit(10),
        "engines": failed.groupBy("parse_engine").agg(F.count("*").alias("failed")),
    }


__all__ = ["backfill_index_status", "backoff", "complete", "dashboard", "dead_since", "depth", "dequeue", "digest", "digest_text", "eligible", "fail", "fallback_chain", "minutes", "reap", "retry_apply", "retry_eligible", "source_kind"]
