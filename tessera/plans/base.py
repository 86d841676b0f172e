"""Registry of queries, and the model's tables as expressions over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: "Now" of every query.
NOW = "2024-01-20 00:00:00"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def micros(name: str) -> Column:
    """A time column as microseconds, which every engine compares alike."""
    return F.unix_micros(F.col(name).cast("timestamp")).alias(name)


#: Columns that both Spark and DuckDB compute from the driver's tables.
DOCUMENT_COLUMNS = (
    "'d' || CAST(event_id AS STRING) AS id",
    "'kb' || CAST(user_id % 7 AS STRING) AS kb_id",
    "'https://h' || CAST(user_id % 17 AS STRING) || '.example/p/' || CAST(event_id AS STRING) AS source",
    "CASE event_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'k/' || CAST(event_id AS STRING) END AS storage_key",
    "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'paddle' WHEN 2 THEN 'pdfium' WHEN 3 THEN 'markitdown' END AS parse_engine",
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'completed' END AS status",
    "CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'indexing_error' WHEN 2 THEN 'too_large' END END AS error_type",
    "'failed with ' || props AS error_msg",
    "ts AS created_at",
)
TASK_COLUMNS = (
    "'t' || CAST(event_id AS STRING) AS id",
    "CASE WHEN event_id % 2 = 0 THEN 'parse_document' ELSE event_type END AS task_type",
    "'{\"doc_id\": \"d' || CAST((event_id * 7) % 10000 AS STRING) || '\"' || CASE event_id % 3 WHEN 0 THEN ', \"source\": \"https://s.example/' || CAST(event_id AS STRING) || '\"' WHEN 1 THEN ', \"source\": \"\", \"filename\": \"f' || CAST(event_id AS STRING) || '.pdf\"' ELSE '' END || '}' AS payload",
    "CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'dead' WHEN 3 THEN 'completed' ELSE 'pending' END AS status",
    "CAST(event_id % 4 AS INT) AS attempts",
    "3 AS max_attempts",
    "CAST(user_id % 3 AS INT) AS priority",
    "ts AS created_at",
    "CASE WHEN event_id % 5 IN (1, 4) THEN ts + INTERVAL 5 MINUTE END AS locked_until",
    "CASE WHEN event_id % 5 IN (2, 3) THEN ts + INTERVAL 1 MINUTE END AS finished_at",
    "CAST(NULL AS TIMESTAMP_NTZ) AS started_at",
    "'' AS error",
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*DOCUMENT_COLUMNS)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*TASK_COLUMNS)


DOCS_SQL = f"docs AS (SELECT {', '.join(DOCUMENT_COLUMNS)} FROM events)"
TASKS_SQL = f"tasks AS (SELECT {', '.join(TASK_COLUMNS)} FROM events)".replace("TIMESTAMP_NTZ", "TIMESTAMP")

#: Addresses of all kinds, made from those of pages.
URL_COLUMN = (
    "CASE page_id % 24 WHEN 0 THEN 'http://user:pw@h.example/x' WHEN 1 THEN 'https://h.example:8080/' || url WHEN 2 THEN 'ftp://h.example/a' WHEN 3 THEN 'https://h.example/film.MP4?x=1' "
    "WHEN 4 THEN '' WHEN 5 THEN 'https:///nohost' WHEN 6 THEN 'https://www.bilibili.com/video/BV' || CAST(page_id AS STRING) WHEN 7 THEN 'https://b23.tv/x' WHEN 8 THEN 'https://mp.weixin.qq.com/s/abc' "
    "WHEN 9 THEN 'https://www.xiaohongshu.com/explore/1?type=video' WHEN 10 THEN 'https://x.com/a/status/1' WHEN 11 THEN 'https://team.feishu.cn/docx/1' WHEN 12 THEN 'https://baike.baidu.com/item/1' "
    "WHEN 13 THEN 'https://mmbiz.qpic.cn/a/640?wx_lazy=1' WHEN 14 THEN 'https://pbs.twimg.com/media/a?format=png&name=small' WHEN 15 THEN 'https://ci.xhscdn.com/a?imageView2/2/format/webp' "
    "WHEN 16 THEN 'http://h.example:80/a?gad_source=1&b=2&utm_x=3&ref=q#frag' WHEN 17 THEN 'https://youku.com/v_show/1' WHEN 18 THEN 'https://notbilibili.com/video/1' WHEN 19 THEN 'https://pbs.twimg.com/media/b' ELSE url END"
)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").selectExpr("page_id", f"{URL_COLUMN} AS u")


URLS_SQL = f"urls AS (SELECT page_id, {URL_COLUMN} AS u FROM pages)"
