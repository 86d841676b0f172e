"""Bounds of keyword search by blocks of places, and sweeps by pairs of hits, against the plain sweep."""

import random

import numpy as np
import pytest

from tessera.functions.similarity import sweep, trigram_list, word_similarity
from tessera.operators import keywords, retrieval


def texts_of(rng, n):
    """Texts of few and of many different trigrams, with lines and words that repeat."""
    vocab = ["".join(rng.choice("thaneoriß中") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([4, 30, 300]))]
    out = []
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 6, 40, 150]))]
        out.append(rng.choice([" ".join(words), (" ".join(words[:6]) + "\n") * rng.randint(1, 30), rng.choice("tha") * rng.randint(1, 300)]))
    return vocab, out


def test_pairs_of_hits_are_the_sweep():
    rng = random.Random(11)
    for _ in range(60):
        vocab, texts = texts_of(rng, 4)
        wanted = set(trigram_list(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 5)))))
        for t in texts:
            grams = trigram_list(t)
            before = keywords._before(*keywords.codes([t]))
            assert keywords.swept(np.array([g in wanted for g in grams], bool), before, len(wanted)) == sweep(wanted, grams)


@pytest.mark.parametrize(("width", "table", "pairs"), [(8, 1 << 22, 512), (64, 1 << 22, 512), (64, 0, 3)])
def test_repeating_texts_against_every_sweep(width, table, pairs, monkeypatch):
    for name, value in {"WIDTH": width, "TABLE": table, "PAIRS": pairs, "BATCH": 20, "LETTERS": 5000, "NUMBERS": 1 << 12}.items():
        monkeypatch.setattr(keywords, name, value)
    rng = random.Random(12)
    for _ in range(5):
        vocab, texts = texts_of(rng, 50)
        queries = ["", *[" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 12]))) for _ in range(12)]]
        scored = [sorted((-word_similarity(q, t), i) for i, t in enumerate(texts)) for q in queries]
        want = [[(i, -s) for s, i in x if -s >= 0.6][:4] for x in scored]
        for floors in ([None] * len(queries), [(w[-1][1], w[-1][0]) if len(w) == 4 else None for w in want]):
            search = keywords.Search(queries, 4, 0.6, floors)
            search.add(list(range(len(texts))), texts)
            got = [[] for _ in queries]
            for q, i, s in zip(*search.results()):
                got[q].append((i, s))
            assert got == want


def test_few_pairs_are_scored(monkeypatch):
    """What the bounds leave of the pairs, by words that share their trigrams."""
    rng = random.Random(13)
    parts = ["th", "an", "er", "in", "on", "ti", "ea"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(130)) for _ in range(1000)]
    calls = []
    monkeypatch.setattr(keywords, "swept", lambda *a, f=keywords.swept: calls.append(1) or f(*a))
    search = keywords.Search([" ".join(rng.sample(words, 3)) for _ in range(40)], 10, 0.6, [None] * 40)
    search.add(list(range(1000)), texts)
    assert 0 < len(calls) < 0.1 * 40 * 1000


def test_parts_of_parts_lose_nothing(spark, monkeypatch):
    """Floors come from a part of the chunks, and that part's own from a part of it."""
    monkeypatch.setattr(retrieval, "FIRST", 20)
    monkeypatch.setattr(retrieval, "SHARE", 3)
    rng = random.Random(14)
    vocab = ["".join(rng.choice("thaneori") for _ in range(rng.randint(2, 6))) for _ in range(25)]
    rows = [(f"c{i}", "a", " ".join(rng.choice(vocab) for _ in range(30))) for i in range(400)]
    queries = [(i, "a", " ".join(rng.sample(vocab, 2))) for i in range(8)]
    seen = []
    monkeypatch.setattr(retrieval, "written", lambda df, f=retrieval.written: seen.append(1) or f(df))
    got = retrieval.keyword_search(spark.createDataFrame(queries, "query_id long, kb_id string, query string"), spark.createDataFrame(rows, "chunk_id string, kb_id string, content string"), 5)
    want = set()
    for q, _, text in queries:
        scored = sorted((-word_similarity(text, t), c) for c, _, t in rows)
        want |= {(q, c, round(-s, 9), r) for r, (s, c) in enumerate(scored[:5]) if -s >= 0.6}
    assert {(r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in got.collect()} == want and want
    assert len(seen) >= 2


def test_embeddings_of_a_block_are_those_of_each_text():
    texts = ["", None, "é", "İstanbul 中文", "alpha beta " * 90, "a"]
    each = np.concatenate([retrieval.embedded([t], 64) for t in texts])
    assert (retrieval.embedded(texts, 64) == each).all() and each.dtype == np.float32
    assert np.abs(each).sum(axis=1).max() > 50 and (each.sum(axis=1) % 2 == np.array([len((t or "").lower().encode()) + 1 for t in texts]) % 2).all()
