"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs; every stage works
on all its predecessor kept. All but the last return the columns of documents.

* toxicity: documents predicted toxic go.
* near_dedup: of each group of near copies, by five-word shingles, the smallest doc_id stays.
* decontaminate: documents with an occurrence of a benchmark window go.
* secret_scan: secrets in texts are replaced by a mark; n_chars follows.
* bpe: the tokens of each text, with digests of them and of what they decode to.

Nulls, empty texts, repeated rows and empty tables are handled as the operators
define. Columns besides those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, near_dedup, secret_scan, toxicity
from tessera.llm.common import Workspace, table

#: Words of a shingle in the near_dedup stage; op5_near_dedup takes pairs.
SHINGLE = 5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, SHINGLE)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secret_scan", secret_scan_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what one kept is written for the next."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
