"""Prefix sums, order statistics and near hashes against their definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import images, metrics, places, retrieval


def _costs(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp, cost double, note string")


def test_sums_of_a_hot_day_and_a_hot_instant(spark):
    """A third of all rows share one instant, most of the rest one day; null times, null costs and repeats."""
    rng = random.Random(1)
    at = lambda s: f"2024-01-{1 + s // 86400:02d} {s // 3600 % 24:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    seconds = [7200] * 2000 + [rng.randrange(86400) for _ in range(3500)] + [86400 + rng.randrange(3 * 86400) for _ in range(400)] + [None] * 100
    rows = [(i, None if s is None else at(s), rng.choice([None, 0.25, 1.5, 7.0])) for i, s in enumerate(seconds)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "id long, at string, cost double").selectExpr("id", "to_timestamp(at) AS ts", "cost", "'x' AS note")
    got = places.sums_before(df, "cost", F.to_date("ts"), "ts", "id", 32, 16)
    assert got.columns == ["id", "ts", "cost", "note", "before"]
    spent, want = {}, []
    for i, s, cost in sorted(rows, key=lambda r: (r[1] or "", r[0])):
        day = (s or "")[:10]
        want.append((i, round(spent.get(day, 0.0), 6)))
        spent[day] = spent.get(day, 0.0) + (cost or 0.0)
    assert sorted((r.id, round(r.before, 6)) for r in got.collect()) == sorted(want)
    sizes = [r["count"] for r in places.blocks(df, F.to_date("ts"), "ts", "id", 32, 16).groupBy("_key", "_block", "_part").count().collect()]
    assert len(sizes) > 32 and max(sizes) < len(rows) / 10


def test_budget_edges(spark):
    empty = metrics.budget(_costs(spark, []), 1.0)
    assert empty.columns == ["id", "ts", "cost", "note", "spent", "over"] and empty.count() == 0
    one = _costs(spark, [(None, None, None, None)])
    assert [(r.spent, r.over) for r in metrics.budget(one, 0.0).collect()] == [(0.0, False)]
    day = spark.sql("SELECT CAST(id AS BIGINT) AS id, timestamp_seconds(id) AS ts, 0.1D AS cost FROM range(12)")
    assert [r.over for r in metrics.budget(day, 1.0).orderBy("id").collect()] == [False] * 10 + [True] * 2


@pytest.mark.parametrize("most,splits", [(5, 3), (40, 8), (10_000, 64)])
def test_values_at_places(spark, most, splits):
    """Groups of all sizes, one of a single repeated value, one of null; NaN is the largest value."""
    rng = random.Random(most)
    groups = {"a": [rng.gauss(0, 9) for _ in range(700)], "b": [4.0] * 300 + [rng.random() for _ in range(50)], None: [float(rng.randrange(9)) for _ in range(200)], "d": [1.5], "e": [float("nan")] * 60 + [2.0, -1.0, float("inf"), float("-inf")] * 9}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = [(g, p, len(vs)) for g, vs in groups.items() for p in {0, len(vs) // 3, len(vs) // 2, len(vs) - 1, len(vs)}]
    found = places.values_at(df, "v", spark.createDataFrame(wanted + wanted[:2], "g string, place long, n long"), ["g"], most, splits).collect()
    order = {g: sorted(vs, key=lambda v: (math.isnan(v), v)) for g, vs in groups.items()}
    assert sorted((str(r.g), r.place, str(r.value)) for r in found) == sorted((str(g), p, str(order[g][p])) for g, p, n in wanted if p < n)


def test_latency(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(31)] + [("a", None), ("b", 2.0), ("b", 5.0), (None, 1.0), ("c", None)], "g string, ms double")
    got = {r.g: (r.p50, r.p95) for r in retrieval.latency(df, "ms", "g").collect()}
    assert got == {"a": (15.0, 28.0), "b": (3.5, 5.0), None: (1.0, 1.0), "c": (None, None)}
    assert [tuple(r) for r in retrieval.latency(df.where("g = 'a'"), "ms").collect()] == [(15.0, 28.0)]
    assert retrieval.latency(df.where("false"), "ms", "g").count() == 0


def _hashes(spark, values):
    return spark.createDataFrame([(i, None if v is None else f"{v:016x}") for i, v in enumerate(values)], "id long, phash string")


@pytest.mark.parametrize("most", [0, 1, 5, 8])
@pytest.mark.parametrize("crowd", [1000, 2])
def test_near_hashes_against_all_pairs(spark, most, crowd):
    """Families of hashes a few bits apart, which share bands: crowds are split and no pair is lost."""
    rng = random.Random(most)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    values = [flip(base, rng.randrange(7)) for base in (rng.getrandbits(64), 0, (1 << 64) - 1) for _ in range(40)] + [None, 0, 0]
    want = {(a, b, (x ^ y).bit_count()) for a, x in enumerate(values) for b, y in enumerate(values) if a < b and x is not None and y is not None and (x ^ y).bit_count() <= most}
    assert {tuple(r) for r in images.near_images(_hashes(spark, values), most, crowd).collect()} == want


def test_few_pairs_meet(spark):
    """Of 10^5 random hashes some 150,000 pairs meet, not the 5 * 10^9 there are."""
    random_hashes = spark.range(100_000).selectExpr("id", "substr(md5(CAST(id AS STRING)), 1, 16) AS phash")
    assert images.met_images(random_hashes).count() < 500_000
