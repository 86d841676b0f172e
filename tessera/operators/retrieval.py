"""Hybrid retrieval for many queries in one job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tessera.functions.similarity import WORD_THRESHOLD, trigrams
from tessera.operators import keywords, vectors
from tessera.operators.places import joined, values_at
from tessera.operators.vectors import meet, top
from tessera.session import written

RRF_K, TOP_K, RERANK_INPUT = 60, 5, 20
NO_RESULTS = "No relevant information found."


#: Chunks of a group whose contents meet a block of queries, if there are many, of the part that is searched first, and such a part's least share of all.
CONTENTS, FIRST, SHARE = 2048, 4096, 8


def vector_search(queries: DataFrame, chunks: DataFrame, k: int | str = TOP_K) -> DataFrame:
    """Exact cosine search; see vectors.vector_search."""
    return vectors.vector_search(queries, chunks, k)


def trigram_index(chunks: DataFrame) -> DataFrame:
    """Inverted index: (kb_id, trigram, chunk_id)."""
    return chunks.select("kb_id", "chunk_id", F.explode(trigrams(F.col("content"))).alias("trigram"))


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, threshold: float = WORD_THRESHOLD) -> DataFrame:
    """Word-similarity search: (query_id, chunk_id, score, rank); see keywords.

    Of many chunks a part is searched first, one in SHARE or about FIRST: the last
    of a query's k best there is its floor, below which nothing of all chunks can be
    among its k best. All chunks are searched then, those of the part once more. The
    part itself is searched in the same way.
    """
    queries = queries.select("query_id", "kb_id", "query")
    chunks = chunks.select("chunk_id", "kb_id", "content")
    kind = chunks.schema["chunk_id"].dataType
    count = chunks.count()
    parts = count // FIRST
    if parts < 4:
        floors = queries.select("*", F.lit(None).cast("double").alias("floor"), F.lit(None).cast(kind).alias("last"))
    else:
        first = chunks.where(F.pmod(F.xxhash64(F.lit(parts), F.col("chunk_id").cast("string")), F.lit(min(parts, SHARE))) == 0)
        best = keyword_search(queries, first, k, threshold).where(F.col("rank") == k - 1)
        floors = queries.join(written(best.select("query_id", F.col("score").alias("floor"), F.col("chunk_id").alias("last"))), "query_id", "left")
    schema = to_arrow_schema(T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", kind), T.StructField("score", T.DoubleType())]))

    def work(asked: pa.Table, met: pa.Table) -> pa.Table:
        floor = [None if f is None else (f, i) for f, i in zip(asked["floor"].to_pylist(), asked["last"].to_pylist())]
        search = keywords.Search([q or "" for q in asked["query"].to_pylist()], k, threshold, floor)
        search.add(met["chunk_id"].to_pylist(), [t or "" for t in met["content"].to_pylist()])
        q, c, score = search.results()
        return pa.table([asked["query_id"].take(pa.array(q, pa.int64())), pa.array(c, schema.field("chunk_id").type), pa.array(score, pa.float64())], names=schema.names).cast(schema)

    shard = max(CONTENTS // 8, min(CONTENTS, count // (4 * chunks.sparkSession.sparkContext.defaultParallelism)))
    found = meet(floors, chunks, ["kb_id"], work, from_arrow_schema(schema), shard=shard)
    return top(found, "score", k).select("query_id", "chunk_id", "score", "rank")


def fuse(vector: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (query_id, chunk_id, score, rank); all rows of both lists stay.

    A chunk that a list has twice counts twice. Order: score, then vector rank,
    then keyword rank, then id.
    """
    lists = vector.select("query_id", "chunk_id", "rank", F.lit(0).alias("side")).unionByName(keyword.select("query_id", "chunk_id", "rank", F.lit(1).alias("side")))
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"),
        F.min(F.when(F.col("side") == 0, F.col("rank"))).alias("v"),
        F.min(F.when(F.col("side") == 1, F.col("rank"))).alias("w"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("v").asc_nulls_last(), F.col("w").asc_nulls_last(), "chunk_id")
    return fused.select("query_id", "chunk_id", "score", (F.row_number().over(order) - 1).alias("rank"))


def rerank(fused: DataFrame, chunks: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] | None, k: int = TOP_K) -> DataFrame:
    """The first 20 in the scorer's order, cut to k, with their fused scores; without a scorer unchanged."""
    if scorer is None:
        return fused
    head = fused.where(F.col("rank") < RERANK_INPUT).join(chunks.select("chunk_id", "content"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("r").desc_nulls_last(), "rank")
    scored = head.withColumn("r", scorer(F.col("query"), F.col("content")))
    return scored.withColumn("new", F.row_number().over(order) - 1).where(F.col("new") < k).select("query_id", "chunk_id", "score", F.col("new").alias("rank"))


def assemble(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, answer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, context, sources, answer): contents join the ranking only here.

    Without an answerer the answer stays '' where there are results (retrieve only).
    """
    text = ranked.join(chunks.select("chunk_id", "doc_id", "content"), "chunk_id")
    rows = text.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content", "score", "doc_id"))).alias("rows"))
    out = queries.select("query_id", "query").join(rows, "query_id", "left")
    context = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("["), r["rank"] + 1, F.lit("] "), r["content"])), "\n\n")
    sources = F.transform("rows", lambda r: F.struct(r["chunk_id"].alias("chunk_id"), r["content"].alias("content"), r["score"].alias("score"), r["doc_id"].alias("doc_id")))
    found = F.lit("") if answer is None else answer(F.col("query"), F.coalesce(context, F.lit("")))
    return out.select("query_id", F.coalesce(context, F.lit("")).alias("context"), sources.alias("sources"), F.when(F.col("rows").isNull(), F.lit(NO_RESULTS)).otherwise(found).alias("answer"))


def rewrite(queries: DataFrame, rewriter: Callable[[Column], Column]) -> DataFrame:
    """Queries with the rewriter's text; where that is null or blank, the text as it was."""
    new = F.trim(rewriter(F.col("query")))
    return queries.withColumn("query", F.when(F.length(new) > 0, new).otherwise(F.col("query")))


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, scorer: Callable[[Column, Column], Column] | None = None, rewriter: Callable[[Column], Column] | None = None, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Both searches at twice k, fused; not cut to k unless reranked.

    The steps of rewriting and reranking are off without their functions. A
    rewritten query is searched for in both ways, so it is embedded anew.
    """
    if rewriter is not None:
        queries = rewrite(queries, rewriter)
        if embedder is not None:
            queries = queries.withColumn("embedding", embedder(F.col("query")))
    fused = fuse(vector_search(queries, chunks, 2 * k), keyword_search(queries, chunks, 2 * k))
    return rerank(fused, chunks, queries, scorer, k)


def embedded(texts: list[str | None], dim: int) -> np.ndarray:
    """A row for each text: its byte trigrams, in lower case and padded, counted by hash with a sign that the hash has too."""
    padded = [f"  {(t or '').lower()} ".encode() for t in texts]
    raw = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    h = (raw[:-2] * np.uint32(961) + raw[1:-1] * np.uint32(31) + raw[2:]) * np.uint32(2654435761) >> np.uint32(16)
    sizes = np.array([len(p) for p in padded])
    sign = np.where(h >> np.uint32(15) & np.uint32(1), 1.0, -1.0)
    ends = np.cumsum(sizes)[:-1]
    sign[np.concatenate([ends - 2, ends - 1])] = 0.0  # trigrams of two texts
    at = np.repeat(np.arange(len(padded)) * dim, sizes)[: len(h)] + h % np.uint32(dim)
    return np.bincount(at, sign, len(padded) * dim).astype(np.float32).reshape(len(padded), dim)


def embed(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding for tests, signed hashed byte trigrams. Stands in for an external model."""

    @F.pandas_udf("array<float>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([v for lo in range(0, len(texts), 64) for v in embedded(texts.iloc[lo : lo + 64].tolist(), dim)])

    return hashed(text)


def first_hits(ranked: DataFrame, chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, hit_rank): 1-based rank of the first chunk with any of a query's phrases; case counts, '' doesn't."""
    text = ranked.join(chunks.select("chunk_id", "content"), "chunk_id").join(phrases, "query_id")
    hit = F.exists("phrases", lambda p: (p != "") & F.contains(F.col("content"), p))
    return phrases.select("query_id").join(text.where(hit).groupBy("query_id").agg((F.min("rank") + 1).alias("hit_rank")), "query_id", "left")


def scores(hits: DataFrame, *by: str) -> DataFrame:
    """hit@1, 3 and 5 and mean reciprocal rank over queries; a query without a hit counts 0."""
    at = lambda k: F.round(F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")
    mrr = F.round(F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("hit_rank")), F.lit(0.0))), 6).alias("mrr")
    return hits.groupBy(*by).agg(F.count("*").alias("queries"), at(1), at(3), at(5), mrr)


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, and the value at the rounded 95 % place (half to even) of the sorted values; nulls don't count."""
    keys = list(by) or ["_all"]
    rows = df.select(*by, value) if by else df.select(F.lit(0).alias("_all"), value)
    n = F.col("n")
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    places = {"lower": F.floor((n - 1) / 2), "upper": F.ceil((n - 1) / 2), "p95": F.least(F.bround(0.95 * (n - 1), 0), n - 1)}
    wanted = sizes.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), p.cast("long").alias("place")) for k, p in places.items()])).alias("x")).select(*keys, "n", "x.*")
    found = values_at(rows, value, wanted, keys)
    out = joined(wanted, found, [*keys, "place"], "left").groupBy(*keys)
    at = lambda k: F.max(F.when(F.col("what") == k, F.col("value")))
    return out.agg(F.round((at("lower") + at("upper")) / 2, 6).alias("p50"), F.round(at("p95"), 6).alias("p95")).select(*by, "p50", "p95")
