"""Crowds near the threshold: what a block of a list gives back."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_dedup


def table(sets, keys, key, own, comp):
    rows = range(len(sets))
    packed = [np.array(sorted(s), np.uint64) for s in sets]
    return pa.table({
        "key": [key] * len(sets), "i": [min(own)] * len(sets), "j": [max(own)] * len(sets), "c": [100 + r for r in rows], "comp": comp, "own": own, "n": [len(p) for p in packed],
        "sketch": [p[:64].tobytes() for p in packed], "rest": [p[64:].tobytes() for p in packed], "keys": [np.array(k, np.int64).tobytes() for k in keys],
    })


def reached(pairs, n):
    at = list(range(n))
    for a, b in pairs:
        a, b = at[a], at[b]
        at = [min(a, b) if x in (a, b) else x for x in at]
    return at


@pytest.mark.parametrize(("size", "change"), [(50, 4), (300, 25), (300, 36)])
def test_a_block_gives_a_forest_of_links(size, change):
    """All that links connect is connected, by fewer rows than there are sets, pairs that don't link give none."""
    rng = random.Random(size + change)
    origins = [[rng.getrandbits(64) for _ in range(size)] for _ in range(3)]
    sets = []
    for _ in range(60):
        o = list(rng.choice(origins))
        for i in rng.sample(range(size), change):
            o[i] = rng.getrandbits(64)
        sets.append(set(o))
    links = [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = near_dedup._meet(64, (80, 100))(table(sets, [[7]] * 60, 7, [0] * 60, list(range(60)))).to_pylist()
    got = [(r["a"] - 100, r["b"] - 100) for r in got]
    assert {(max(p), min(p)) for p in got} <= set(links)
    assert len(got) < 60 and reached(got, 60) == reached(links, 60)


def test_a_pair_meets_in_its_lowest_list():
    s = set(range(1000, 1050))
    sets = [s | {1}, s | {2}, s | {3}]
    keys = [[3, 7], [3, 7], [7]]
    work = near_dedup._meet(64, (80, 100))
    got = {(r["a"], r["b"]) for r in work(table(sets, keys, 7, [0] * 3, [1, 2, 3])).to_pylist()}
    assert got == {(100, 102), (101, 102)}
    got = {(r["a"], r["b"]) for r in work(table(sets[:2], keys[:2], 3, [0, 1], [1, 2])).to_pylist()}
    assert got == {(100, 101)}
    assert work(table(sets[:2], keys[:2], 3, [0, 1], [1, 1])).num_rows == 0
