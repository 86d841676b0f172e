"""Exact search in blocks and the index of cells against numpy."""

import numpy as np
import pytest

from tessera.operators import vectors

rng = np.random.default_rng(5)


@pytest.fixture(scope="module")
def points():
    """Clustered vectors in kbs of which one holds most, copies, and vectors that can't be found."""
    centres = rng.normal(size=(20, 16)) * 3
    rows = [(f"c{i:04d}", "hot" if i % 4 else f"k{i % 12}", (centres[i % 20] + rng.normal(size=16)).tolist()) for i in range(1200)]
    rows += [(f"d{i:02d}", "hot", rows[1][2]) for i in range(30)]
    return rows + [("n0", "hot", None), ("n1", "hot", []), ("n2", "hot", [0.0] * 16), ("n3", "hot", [1.0, 2.0]), ("n4", None, rows[0][2]), ("n5", "hot", [float("nan")] * 16)]


@pytest.fixture(scope="module")
def chunks(spark, points):
    return spark.createDataFrame(points, "chunk_id string, kb_id string, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark, points):
    some = [(i, kb, v, 1 + i % 7) for i, (_, kb, v) in enumerate(points[:60])] + [(90, "hot", None, 3), (91, "none", points[0][2], 3), (92, None, points[0][2], 3), (93, "hot", [0.0] * 16, 3), (94, "hot", points[0][2], 0), (95, "hot", [3.0, 4.0], 2), (96, "hot", points[1][2], 25)]
    return spark.createDataFrame(some, "query_id long, kb_id string, embedding array<float>, k int")


def exact(queries, points):
    out = set()
    for q in queries:
        if not q.embedding or q.kb_id is None:
            continue
        a, scored = np.array(q.embedding, np.float64), []
        for c, kb, v in points:
            if kb == q.kb_id and v and len(v) == len(a):
                b = np.array(v, np.float32).astype(np.float64)
                with np.errstate(all="ignore"):
                    s = round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12)
                if np.isfinite(s):
                    scored.append((-round(s, 9), c))
        out |= {(q.query_id, c, i) for i, (_, c) in enumerate(sorted(scored)[: q.k])}
    return out


@pytest.mark.parametrize(("block", "shard", "product"), [(2000, 50_000, 1 << 22), (7, 40, 1 << 22), (2000, 50_000, 300)])
def test_exact_search(queries, chunks, points, block, shard, product, monkeypatch):
    meet = vectors.meet
    monkeypatch.setattr(vectors, "meet", lambda *a: meet(*a, block=block, shard=shard))
    got = vectors.vector_search(queries, chunks, "k").collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == exact(queries.collect(), points) and len(got) > 200


def test_rows_that_leave_a_group(queries, chunks, monkeypatch):
    """At most k rows a query and shard leave the groups, whatever they hold, and no group holds more than about a shard."""
    made, meet = [], vectors.meet
    monkeypatch.setattr(vectors, "meet", lambda *a: made.append(meet(*a, block=7, shard=40)) or made[-1])
    vectors.vector_search(queries, chunks, "k")
    shards = -(-chunks.where("kb_id = 'hot'").count() // 40)
    rows = made[0].groupBy("query_id").count().collect()
    wanted = {r.query_id: r.k for r in queries.collect()}
    assert len(rows) > 50 and all(r["count"] <= wanted[r.query_id] * shards for r in rows)


@pytest.mark.parametrize("k", [1, 3, 8, 50])
def test_best_takes_the_leftmost_of_ties(k):
    scores = rng.integers(0, 4, size=(40, 20)).astype(float)
    rows, columns = vectors.best(scores, k)
    for i in range(40):
        assert sorted(columns[rows == i]) == sorted(sorted(range(20), key=lambda j: (-scores[i, j], j))[:k])


def test_index(spark, queries, chunks, points):
    centroids = vectors.fit_cells(chunks)
    assert 30 <= len(centroids) <= 36 and np.allclose((centroids**2).sum(axis=1), 1, atol=1e-5)
    index = vectors.build_index(chunks, centroids).persist()
    usable = {c for c, _, v in points if v and len(v) == 16 and np.isfinite(v).all() and any(v)}
    assert sorted(r.chunk_id for r in index.collect()) == sorted(usable)  # every row once
    some = queries.where("query_id < 60 AND kb_id IS NOT NULL")
    want = vectors.vector_search(some, chunks, 5)
    probes = vectors.fit_probes(chunks, index, centroids, 5)
    assert 1 <= probes < len(centroids)
    found = vectors.recall(vectors.ann_search(some, index, chunks, centroids, 5, probes), want).first()
    assert found.queries == 60 and found.recall >= 0.9
    few = vectors.recall(vectors.ann_search(some, index, chunks, centroids, 5, 1), want).first()
    all_cells = vectors.recall(vectors.ann_search(some, index, chunks, centroids, 5, len(centroids)), want).first()
    assert few.recall < all_cells.recall >= 0.99
    odd = vectors.ann_search(queries.where("query_id >= 90"), index, chunks, centroids, 5, probes).collect()
    assert {r.query_id for r in odd} == {94, 96}  # the index has its own k


def test_empty_tables(queries, chunks):
    none = chunks.where("false")
    centroids = vectors.fit_cells(none)
    index = vectors.build_index(none, centroids)
    assert vectors.vector_search(queries, none, 3).count() == 0 == vectors.vector_search(queries.where("false"), chunks, 3).count()
    assert index.count() == 0 and vectors.ann_search(queries, index, none, centroids, 3, 1).count() == 0
    assert vectors.recall(index.selectExpr("1 AS query_id", "chunk_id"), index.selectExpr("1 AS query_id", "chunk_id")).first().recall is None
