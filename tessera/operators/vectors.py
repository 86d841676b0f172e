"""Nearest vectors: exact search over blocks, and an index of inverted cells.

Queries are a table, not something the driver holds. Both sides are dealt to
groups of bounded size: the queries of a knowledge base to blocks, its chunks
to shards, and each block meets each shard in one group. A group keeps the k
best of each of its queries, so k rows a query leave it; these meet in a window.
A hot knowledge base has more shards, none of them larger.

The index puts every vector into the cell of its nearest centroid and keeps
what is left as bytes. A query reads the cells whose centroids are nearest, by
a join on knowledge base and cell, and the best by these codes are scored again
by their own vectors. Centroids are fitted on at most SAMPLE vectors, and how
many cells a query reads on the exact results of a few. Only cells that hold
vectors of a query's knowledge base count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.similarity import cosine

#: Queries of a block, chunks of a shard, numbers in a product of matrices.
QUERY_BLOCK, SHARD, PRODUCT = 2000, 50_000, 1 << 22
#: Vectors that centroids are fitted on, and centroids at most.
SAMPLE, MOST_CELLS = 20_000, 4096
ROUNDS = 8
#: Candidates by code that are scored exactly, for each result wanted.
REFINE = 4


def top(df: DataFrame, score: str, k: Column | int, keys: tuple[str, ...] = ("query_id",), tie: str = "chunk_id") -> DataFrame:
    """The k best of each query, ranked from 0; equal scores by id."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def meet(queries: DataFrame, chunks: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str | T.StructType, block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """Each query with all chunks of its keys, in groups of at most about block queries and shard chunks.

    Keys of both sides are counted first. A null key meets nothing.
    """
    counted = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    sizes = counted(queries, "_q").join(counted(chunks, "_c"), keys)
    sizes = sizes.select(*keys, F.ceil(F.col("_q") / block).cast("int").alias("_blocks"), F.ceil(F.col("_c") / shard).cast("int").alias("_shards"))
    share = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("string")), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, keys).withColumn("_block", share("query_id", "_blocks")).withColumn("_shard", copies("_shards")).drop("_blocks", "_shards")
    right = chunks.join(sizes, keys).withColumn("_shard", share("chunk_id", "_shards")).withColumn("_block", copies("_blocks")).drop("_blocks", "_shards")
    by = [*keys, "_block", "_shard"]
    # a stated number of partitions, as small rows may cost much and are not to be put together; both sides may come from one table
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * 2
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(tasks, *by) for df in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(work, schema)


def matrix(vectors: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors scaled to length 1) of the vectors with this many numbers, none of them null, and a length."""
    vectors = vectors.combine_chunks()
    vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    rows = np.flatnonzero(sizes == dim)
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    with np.errstate(all="ignore"):
        length = np.sqrt((flat * flat).sum(axis=1))
        fits = np.isfinite(length) & (length > 0)
        return rows[fits], flat[fits] / length[fits, None]


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k greatest numbers, the leftmost of equal ones."""
    n, m = scores.shape
    if m <= k:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(scores, at, axis=1).min(axis=1)
    for i in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > k):  # ties at the end
        over, equal = np.flatnonzero(scores[i] > least[i]), np.flatnonzero(scores[i] == least[i])
        at[i] = np.concatenate([over, equal[: k - len(over)]])
    return np.repeat(np.arange(n), k), at.ravel()


def k_best(asked: np.ndarray, k: np.ndarray, parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, chunk, score) of the k best of each query; parts gives (first chunk, vectors) in order of chunk ids.

    Of what was seen before a part only the k best are held.
    """
    most = int(k.max(initial=0))
    q = c = np.zeros(0, np.int64)
    s = np.zeros(0)
    for first, vectors in parts:
        scores = np.round(asked @ vectors.T, 12)
        i, j = best(scores, most)
        q, c, s = np.concatenate([q, i]), np.concatenate([c, j + first]), np.concatenate([s, scores[i, j]])
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k[q]
        q, c, s = q[keep], c[keep], s[keep]
    return q, c, s


def _sliced(vectors: np.ndarray, queries: int):
    step = max(1, PRODUCT // max(queries, 1))
    for i in range(0, len(vectors), step):
        yield i, vectors[i : i + step]


def _found(asked: pa.Table, ids: pa.Array, q: np.ndarray, c: np.ndarray, s: np.ndarray) -> pa.Table:
    of = asked.take(pa.array(q))
    return pa.table({"query_id": of["query_id"], "k": of["k"], "chunk_id": ids.take(pa.array(c)), "score": pa.array(s, pa.float64())})


def _schema(queries: DataFrame, chunks: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, k int, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"


def vector_search(queries: DataFrame, chunks: DataFrame, k: int | str) -> DataFrame:
    """Exact cosine search: (query_id, chunk_id, score, rank) of the k nearest chunks in the query's kb.

    queries: query_id, kb_id, embedding; chunks: chunk_id, kb_id, embedding. Null,
    empty and zero vectors and those of another length than the query's are not
    found; equal scores are ranked by id. k may name a column of queries.
    """
    queries = queries.select("query_id", "kb_id", (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int").alias("k"), "embedding")
    schema = _schema(queries, chunks)
    empty = _empty(schema)

    def work(asked: pa.Table, met: pa.Table) -> pa.Table:
        out = [empty]
        met = met.sort_by("chunk_id")
        for dim in set(pc.list_value_length(asked["embedding"]).to_pylist()) - {None, 0}:
            rows, wanted = matrix(asked["embedding"], dim)
            own, vectors = matrix(met["embedding"], dim)
            q, c, s = k_best(wanted, asked["k"].to_numpy()[rows], _sliced(vectors, len(rows)))
            out.append(_found(asked, met["chunk_id"], rows[q], own[c], s).cast(empty.schema))
        return pa.concat_tables(out)

    found = meet(queries.where("k > 0"), chunks.select("chunk_id", "kb_id", "embedding"), ["kb_id"], work, schema)
    return top(found, "score", F.col("k")).select("query_id", "chunk_id", "score", "rank")


def _empty(schema: str) -> pa.Table:
    return to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()


# The index


def fit_cells(chunks: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of length 1 by spherical k-means over a sample, the smallest vectors by hash of their ids.

    As many cells as the square root of the number of vectors, MOST_CELLS at
    most, unless stated. No vectors, no centroids.
    """
    usable = chunks.where(F.size("embedding") > 0)
    cells = cells or min(MOST_CELLS, max(1, round(usable.count() ** 0.5)))
    taken = usable.orderBy(F.xxhash64(F.col("chunk_id").cast("string")), "chunk_id").limit(sample).select("embedding").toArrow()
    dims = pc.list_value_length(taken["embedding"]).to_numpy()
    if not len(dims):
        return np.zeros((0, 0), np.float32)
    dim = int(np.bincount(dims).argmax())
    _, x = matrix(taken["embedding"], dim)
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)] if len(x) else np.zeros((0, dim))
    for _ in range(ROUNDS if len(x) else 0):
        of, sums = nearest(x, centroids, 1)[:, 0], np.zeros_like(centroids)
        np.add.at(sums, of, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        held = length > 0
        centroids[held] = sums[held] / length[held, None]
    return centroids.astype(np.float32)


def nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector, in order."""
    n = min(n, len(centroids))
    out = np.zeros((len(vectors), n), np.int64)
    for i, part in _sliced(vectors, len(centroids)):
        scores = part @ centroids.T
        _, at = best(scores, n)
        at = at.reshape(len(part), n)
        out[i : i + len(part)] = np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, axis=1), axis=1, kind="stable"), axis=1)
    return out


def build_index(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(kb_id, cell, chunk_id, code, scale): every vector that can be found, as bytes about its cell's centroid.

    Centroids are broadcast: MOST_CELLS vectors at most. Null, empty and zero
    vectors and those of another length than the centroids' are not indexed.
    """
    sent = chunks.sparkSession.sparkContext.broadcast(centroids)
    kinds = chunks.schema

    def work(batches):
        centroids = sent.value
        for batch in batches:
            rows, x = matrix(pa.chunked_array([batch.column("embedding")]), centroids.shape[1])
            if len(rows) and len(centroids):
                cell = nearest(x, centroids, 1)[:, 0]
                left = x - centroids[cell]
                scale = np.maximum(np.abs(left).max(axis=1), 1e-12) / 127
                codes = np.round(left / scale[:, None]).astype(np.int8)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("kb_id").take(at), pa.array(cell, pa.int32()), batch.column("chunk_id").take(at), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale, pa.float64())], names=["kb_id", "cell", "chunk_id", "code", "scale"])

    schema = f"kb_id {kinds['kb_id'].dataType.simpleString()}, cell int, chunk_id {kinds['chunk_id'].dataType.simpleString()}, code binary, scale double"
    return chunks.select("kb_id", "chunk_id", "embedding").mapInArrow(work, schema)


def probe(queries: DataFrame, index: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """queries, a row for each of the nearest cells that hold vectors of their kb: with cell, and place, its place among them."""
    sent = queries.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("place", T.IntegerType())])
    held = index.groupBy("kb_id").agg(F.array_sort(F.collect_set("cell")).alias("_cells"))  # MOST_CELLS numbers at most

    def work(batches):
        for batch in batches:
            rows, x = matrix(pa.chunked_array([batch.column("embedding")]), sent.value.shape[1])
            cells = batch.column("_cells")
            kinds: dict[tuple, int] = {}
            of = np.array([kinds.setdefault(tuple(c), len(kinds)) for c in cells.take(pa.array(rows)).to_pylist()], np.int64)
            for kind in range(len(kinds)):
                at = np.flatnonzero(of == kind)
                own = np.array(cells[int(rows[at[0]])].as_py())
                near = own[nearest(x[at], sent.value[own], probes)]
                out = batch.drop_columns(["_cells"]).take(pa.array(np.repeat(rows[at], near.shape[1])))
                places = np.tile(np.arange(near.shape[1]), len(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel(), pa.int32()), pa.array(places, pa.int32())], schema=to_arrow_schema(schema))

    return queries.join(held, "kb_id").select(*queries.columns, "_cells").mapInArrow(work, schema)


def fit_probes(chunks: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, target: float = 0.95, sample: int = 200) -> int:
    """How many cells to read so that this share of the nearest vectors lies in them.

    The vectors nearest to a sample of the chunks, the smallest by a hash of
    their ids, are found exactly, and the places of their cells in the
    sample's order of cells are counted: one number for each place.
    """
    mixed = F.xxhash64(F.col("chunk_id").cast("string"), F.lit("probe"))
    asked = chunks.where(F.size("embedding") > 0).orderBy(mixed, "chunk_id").limit(sample).select(F.col("chunk_id").alias("query_id"), "kb_id", "embedding")
    exact = vector_search(asked, chunks, k + 1).where(~F.col("query_id").eqNullSafe(F.col("chunk_id"))).select("query_id", "chunk_id")
    places = probe(asked, index, centroids, max(1, len(centroids))).select("query_id", "cell", "place")
    at = exact.join(index.select("chunk_id", "cell"), "chunk_id").join(places, ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("n"))
    n = np.zeros(max(1, len(centroids)), np.int64)
    for row in at.toLocalIterator():
        n[row["place"]] = row["n"]
    return min(len(n), int(np.searchsorted(n.cumsum(), target * n.sum())) + 1)


def ann_search(queries: DataFrame, index: DataFrame, chunks: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """Approximate cosine search by the index: (query_id, chunk_id, score, rank), scores exact.

    Reads the probes nearest cells of each query; fit_probes says how many. All
    cells give the exact result but for candidates that codes misplace.
    """
    queries = queries.select("query_id", "kb_id", F.lit(k * REFINE).cast("int").alias("k"), "embedding")
    schema = _schema(queries, index)
    empty = _empty(schema)
    sent = queries.sparkSession.sparkContext.broadcast(centroids)

    def work(asked: pa.Table, met: pa.Table) -> pa.Table:
        if not asked.num_rows or not met.num_rows:
            return empty
        rows, wanted = matrix(asked["embedding"], sent.value.shape[1])
        met = met.sort_by("chunk_id")
        centre = sent.value[met["cell"][0].as_py()].astype(np.float64)
        codes = np.frombuffer(b"".join(met["code"].to_pylist()), np.int8).reshape(met.num_rows, -1)
        vectors = centre + codes * met["scale"].to_numpy()[:, None]
        q, c, s = k_best(wanted, asked["k"].to_numpy()[rows], _sliced(vectors, len(rows)))
        return _found(asked, met["chunk_id"], rows[q], c, s).cast(empty.schema)

    near = top(meet(probe(queries, index, centroids, probes).drop("place"), index, ["kb_id", "cell"], work, schema), "score", F.col("k")).select("query_id", "chunk_id")
    asked = queries.select("query_id", F.col("kb_id").alias("_kb"), F.col("embedding").alias("_wanted"))
    exact = near.join(chunks.select("chunk_id", "kb_id", "embedding"), "chunk_id").join(asked, "query_id").where(F.col("kb_id") == F.col("_kb"))
    scored = exact.select("query_id", "chunk_id", F.round(cosine(F.col("_wanted"), F.col("embedding")), 12).alias("score"))
    return top(scored, "score", k).select("query_id", "chunk_id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, wanted, found and the share of exact results that were found."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").withColumn("_hit", F.lit(1)).distinct(), ["query_id", "chunk_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("_hit").alias("found"), F.try_divide(F.count("_hit"), F.count("*")).alias("recall"))
