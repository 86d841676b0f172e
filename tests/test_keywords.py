"""Keyword search by bounds against the sweep of every pair."""

import random

import pytest

from tessera.functions.similarity import sweep, trigram_list, word_similarity
from tessera.operators import keywords, retrieval


def made(n, seed, words=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñß中") for _ in range(rng.randint(1, 9))) for _ in range(words)]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 60, 150]))) for _ in range(n - 4)]
    return vocab, [*texts, "", "x " * 700, "İstanbul_Ab 3 " * 3, "a" * 900]


def test_codes_are_the_trigrams():
    _, texts = made(60, 1)
    grams, begin = keywords.codes(texts)
    assert [grams[a:z].tolist() for a, z in zip(begin, begin[1:])] == [[keywords.code(g) for g in trigram_list(t)] for t in texts]


@pytest.mark.parametrize(("k", "floor"), [(1, False), (7, False), (7, True), (1000, False)])
def test_search_against_every_sweep(k, floor, monkeypatch):
    vocab, texts = made(300, 2)
    rng = random.Random(3)
    queries = ["", "?", vocab[0], "a", "x x", *[" ".join(rng.sample(vocab, rng.randint(1, 5))) for _ in range(40)]]
    monkeypatch.setattr(keywords, "BATCH", 64)
    want = []
    for q in queries:
        scored = [(-word_similarity(q, t), i) for i, t in enumerate(texts)]
        want.append([(i, -s) for s, i in sorted(scored) if -s >= 0.6][:k])
    floors = [(w[-1][1], w[-1][0]) if floor and len(w) == k else None for w in want]
    search = keywords.Search(queries, k, 0.6, floors)
    search.add(list(range(len(texts))), texts)
    got = [[] for _ in queries]
    for q, i, s in zip(*search.results()):
        got[q].append((i, s))
    assert got == want


def test_few_pairs_are_swept(monkeypatch):
    vocab, texts = made(600, 4, 2000)
    rng = random.Random(5)
    queries = [" ".join(rng.sample(vocab, 3)) for _ in range(50)]
    calls = []
    monkeypatch.setattr(keywords, "sweep", lambda *a: calls.append(1) or sweep(*a))
    keywords.Search(queries, 10, 0.6, [None] * 50).add(list(range(600)), texts)
    assert len(calls) < 0.02 * 50 * 600


def test_floors_of_a_first_part_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "FIRST", 50)
    vocab, texts = made(400, 6, 25)
    rng = random.Random(7)
    queries = [(i, kb, " ".join(rng.sample(vocab, 2))) for i, kb in enumerate("aab" * 4)]
    rows = [(f"c{i}", "ab"[i % 2], t) for i, t in enumerate(texts)]
    got = retrieval.keyword_search(spark.createDataFrame(queries, "query_id long, kb_id string, query string"), spark.createDataFrame(rows, "chunk_id string, kb_id string, content string"), 5)
    want = set()
    for q, kb, text in queries:
        scored = sorted((-word_similarity(text, t), c) for c, b, t in rows if b == kb)
        want |= {(q, c, round(-s, 9), r) for r, (s, c) in enumerate(scored[:5]) if -s >= 0.6}
    assert {(r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in got.collect()} == want and len(want) > 40
