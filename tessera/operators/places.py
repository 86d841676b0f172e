"""Places in an order, found without one task that holds the whole order: prefix sums and order statistics."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

#: Bounds by time and, where one instant is crowded, by id.
TIMES, IDS = 1024, 64
#: Different values of a range that one task may sort.
SORTED = 100_000
#: Splitters by which a larger range is cut in a round.
SPLITS = 64
_STEP = 32


def bounds(df: DataFrame, c: Column, n: int) -> list[int]:
    """At most ``n`` values of a column of longs that cut its rows into parts of similar size."""
    found = df.agg(F.percentile_approx(c, [k / n for k in range(n)], 10_000)).first()[0]
    return sorted(set(found or []))


def _literal(cuts: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")


def _at_most(c: Column, cuts: list[int]) -> tuple[Column, Column]:
    """How many of the sorted cuts are at most c, and whether c is one: first among every 32nd, then among those behind it."""
    if not cuts:
        return F.lit(0), F.lit(False)
    many = lambda xs: F.size(F.filter(xs, lambda x: x <= c))
    head = F.greatest(many(_literal(cuts[::_STEP])) - 1, F.lit(0))
    rest = F.get(F.array(*[_literal(cuts[k : k + _STEP]) for k in range(0, len(cuts), _STEP)]), head)
    return head * _STEP + many(rest), F.array_contains(rest, c)


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once for a row, not at each use."""
    return F.get(F.transform(F.array(c), f), 0)


def _block(c: Column, cuts: list[int]) -> Column:
    """Odd numbers for the values that are cuts, even ones for those between them; in the order of c."""

    def numbered(x: Column) -> Column:
        place, cut = _at_most(x, cuts)
        return 2 * place - cut.cast("int")

    return _once(c, numbered)


_BLOCK = ["_key", "_block", "_part"]


def blocks(df: DataFrame, key: Column, ts: str, id_: str, times: int = TIMES, ids: int = IDS) -> DataFrame:
    """df with _key, _block and _part: blocks of a key's rows, in the order of (ts, id).

    Bounds of time cut them, a bound being a block of its own, which bounds of ids
    cut again: a block has about a times-th of all rows at most, of one instant an
    ids-th, and more only where one (ts, id) repeats. Null times and ids come first; ids are integers.
    """
    at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62)))
    number = F.coalesce(F.col(id_).cast("long"), F.lit(-(1 << 62)))
    cuts, parts = bounds(df, at, times), bounds(df, number, ids)
    rows = df.withColumn("_key", F.coalesce(key.cast("string"), F.lit(""))).withColumn("_block", _block(at, cuts))
    return rows.withColumn("_part", F.when(F.col("_block") % 2 == 1, _once(number, lambda x: _at_most(x, parts)[0])).otherwise(0))


def sums_before(df: DataFrame, value: str, key: Column, ts: str, id_: str, times: int = TIMES, ids: int = IDS) -> DataFrame:
    """df with ``before``: the sum of a key's values that come earlier by (ts, id), 0 for a first row.

    Sums of blocks are few, 2 * times * ids of a key at most; their prefix sums
    join the rows of each block, which are summed on their own. Null values add nothing.
    """
    rows = blocks(df, key, ts, id_, times, ids)
    earlier = (Window.unboundedPreceding, -1)
    sums = rows.groupBy(*_BLOCK).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*_BLOCK, F.sum("_sum").over(Window.partitionBy("_key").orderBy("_block", "_part").rowsBetween(*earlier)).alias("_offset"))
    inner = F.sum(value).over(Window.partitionBy(*_BLOCK).orderBy(ts, id_).rowsBetween(*earlier))
    zero = F.lit(0.0)
    return rows.join(offsets, _BLOCK, "left").withColumn("before", F.coalesce("_offset", zero) + F.coalesce(inner, zero)).drop(*_BLOCK, "_offset")


def joined(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """a and b where the named columns agree, nulls included; the names stay once."""
    other = b.withColumnsRenamed({n: f"_b_{n}" for n in names})
    same = functools.reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_b_{n}")) for n in names])
    return a.join(other, same, how).drop(*[f"_b_{n}" for n in names])


def _within(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside the ranges of their group that hold them."""
    return joined(rows, ranges, by).where("_v >= low AND _v <= high")


def _refined(rows: DataFrame, state: DataFrame, by: list[str], splits: int) -> DataFrame:
    """Each place with the part of its range that holds it, by exact counts of the parts between splitters."""
    keys = [*by, "low", "high", "below"]
    ranges = state.select(*keys).distinct()
    inside = _within(rows, ranges, by)
    # any splitters are right; approximate quantiles make the parts small
    cuts = inside.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", [k / splits for k in range(splits)], 20 * splits)).alias("_cuts"))
    cut = _within(rows, cuts, by)
    p = F.size(F.filter("_cuts", lambda x: x <= F.col("_v")))
    part = 2 * p - F.coalesce((F.get("_cuts", p - 1) == F.col("_v")).cast("int"), F.lit(0))
    counted = cut.select(*keys, "_v", part.alias("_part")).groupBy(*keys, "_part").agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("z"))
    lower = F.sum("n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = counted.withColumn("_below", F.col("below") + F.coalesce(lower, F.lit(0)))
    met = joined(state, parts, keys).where("place >= _below AND place < _below + n")
    return met.select(*by, "place", F.col("a").alias("low"), F.col("z").alias("high"), F.col("_below").alias("below"), F.when(F.col("a") == F.col("z"), 0).otherwise(F.col("n")).alias("size"))


def values_at(df: DataFrame, value: str, wanted: DataFrame, by: list[str], most: int = SORTED, splits: int = SPLITS) -> DataFrame:
    """(by..., place, value): the value at each wanted place, from 0, of a group's sorted values.

    ``wanted`` has (by..., place, n), n being the group's number of values that are
    not null. A place's range of values is cut by splitters and its parts are
    counted, until the range holds ``most`` rows or one value; only that range
    is sorted. Each round leaves about a ``splits``-th, and the driver reads one number.
    Values are taken as doubles, NaN being the largest; repeated wanted rows count once.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    # no value is below the one bound or above the other
    state = wanted.where("place >= 0 AND place < n").select(*by, F.col("place").cast("long").alias("place"), F.lit(float("-inf")).alias("low"), F.lit(float("nan")).alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").cast("long").alias("size")).distinct()
    while (state.agg(F.max("size")).first()[0] or 0) > most:
        refined = _refined(rows, state.where(F.col("size") > most), by, splits)
        state = written(refined.unionByName(state.where(F.col("size") <= most)))
    one = state.where(F.col("size") == 0).select(*by, "place", F.col("low").alias("value"))
    left = state.where(F.col("size") > 0)
    keys = [*by, "low", "high", "below"]
    counted = _within(rows, left.select(*keys).distinct(), by).groupBy(*keys, "_v").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto)
    met = joined(left, placed, keys).where("place < _upto AND place >= _upto - n")
    return one.unionByName(met.select(*by, "place", F.col("_v").alias("value")))
