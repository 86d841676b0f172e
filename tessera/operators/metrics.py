"""Metric windows over a long table (ts, metric, labels..., value), evaluated on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.places import sums_before


def latest(samples: DataFrame, *by: str) -> DataFrame:
    """The last value of each series."""
    return samples.groupBy(*by).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def increases(samples: DataFrame, *by: str) -> DataFrame:
    """samples with the increase since the sample before in its series; a drop is a reset and counts from 0.

    Not extrapolated to window ends.
    """
    w = Window.partitionBy(*by).orderBy("ts", "value")
    before = F.lag("value").over(w)
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value")))


def sliding(ts: Column, size: str, step: str) -> Column:
    return F.window(ts, size, step)


def ratio(events: DataFrame, bad: Column, size: str, step: str, floor: float, limit: float, *by: str) -> DataFrame:
    """Windows where the share of bad events is over the limit and all events reach the floor."""
    grouped = events.groupBy(F.window("ts", size, step).alias("w"), *by).agg(F.count("*").alias("total"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"))
    share = F.try_divide("bad", "total")
    return grouped.where((share > limit) & (F.col("total") >= floor)).select(F.col("w.start").alias("start"), *by, "total", "bad", F.round(share, 6).alias("share"))


def quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """Quantile from cumulative buckets (le, count): linear inside the bucket where it falls.

    In the last, unbounded bucket it is the highest finite bound; without any
    observation it is null. Bounds and counts of a series are few.
    """
    rows = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", "count"))).alias("b"))
    total = F.element_at("b", -1)["count"]
    rank = F.lit(q) * total
    at = F.array_position(F.transform("b", lambda x: x["count"] >= rank), True).cast("int")
    hit = F.get("b", at - 1)
    below = F.when(at > 1, F.get("b", at - 2))
    low, low_count = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["count"], F.lit(0))
    inner = low + (hit["le"] - low) * F.try_divide(rank - low_count, hit["count"] - low_count)
    value = F.when(total == 0, F.lit(None)).when(hit["le"] == F.lit(float("inf")), low).otherwise(inner)
    return rows.select(*by, F.round(value, 6).alias("value"))


def held(flags: DataFrame, hold_s: int, *by: str) -> DataFrame:
    """Evaluations (ts, firing) with whether the condition held all through the time before."""
    w = Window.partitionBy(*by).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-hold_s, 0)
    first = F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).over(Window.partitionBy(*by))
    long_enough = F.unix_seconds(F.col("ts").cast("timestamp")) - first >= hold_s
    return flags.withColumn("alert", F.min(F.col("firing").cast("int")).over(w).cast("boolean") & long_enough)


def grid(start: str, end: str, step: str) -> Column:
    """Evaluation times from start to end."""
    return F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {step}"))


# Alerts that silence the groups of others.
INHIBITS = {"worker_absent": ("worker", "queue", "parser", "documents"), "api_absent": ("api",)}


def grouped_alerts(alerts: DataFrame) -> DataFrame:
    """Active alerts (name, severity, area) by name and severity, without those that another one silences."""
    rules = [(n, a) for n, areas in INHIBITS.items() for a in areas]
    table = alerts.sparkSession.createDataFrame(rules, "source string, area string")
    silenced = alerts.select(F.col("name").alias("source")).distinct().join(F.broadcast(table), "source").select("area").distinct()
    shown = alerts.where(F.col("name").isin(*INHIBITS)).unionByName(alerts.where(~F.col("name").isin(*INHIBITS)).join(silenced, "area", "left_anti").select(*alerts.columns))
    return shown.groupBy("name", "severity").agg(F.count("*").alias("alerts"))


def gauge_shares(used: DataFrame, limits: DataFrame, *by: str) -> DataFrame:
    """The last value of each series over that of its own limit; limits of 0 don't count."""
    both = latest(used, *by).withColumnRenamed("value", "used").join(latest(limits, *by).withColumnRenamed("value", "limit"), list(by))
    return both.where("limit > 0").select(*by, F.try_divide("used", "limit").alias("share"))


def instance_ratio(used: DataFrame, limits: DataFrame, most: float) -> DataFrame:
    """Instances whose last value is over a share of their own limit."""
    return gauge_shares(used, limits, "instance").where(F.col("share") > most).withColumn("share", F.round("share", 6))


def gauge_sums(samples: DataFrame, series: tuple[str, ...], *by: str) -> DataFrame:
    """The last values of all series, added up by some of their labels or none."""
    return latest(samples, *series).groupBy(*by).agg(F.sum("value").alias("value"))


#: A rate that a share is taken of counts as at least this many a second.
LEAST_RATE = 0.001


def rates(events: DataFrame, size_s: int, *by: str) -> DataFrame:
    """(start, by..., rate): events a second in windows that do not overlap."""
    counted = events.groupBy(F.window("ts", f"{size_s} seconds").alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, F.round(F.col("n") / size_s, 6).alias("rate"))


def rate_shares(events: DataFrame, part: Column, size_s: int, *by: str) -> DataFrame:
    """(start, by..., share): the rate of a part of the events over the rate of all, the latter clamped from below."""
    counted = events.groupBy(F.window("ts", f"{size_s} seconds").alias("w"), *by).agg(F.count("*").alias("n"), F.count_if(part).alias("k"))
    share = F.col("k") / size_s / F.greatest(F.col("n") / size_s, F.lit(LEAST_RATE))
    return counted.select(F.col("w.start").alias("start"), *by, F.round(share, 6).alias("share"))


def budget(costs: DataFrame, cap: float) -> DataFrame:
    """Costs (ts, id, cost) with what was spent before on the same UTC day and whether the cap was reached; no cap from 0 down.

    Sums are rounded to six decimals before they meet the cap.
    """
    spent = F.round("before", 6)
    return sums_before(costs, "cost", F.to_date("ts"), "ts", "id").withColumn("spent", spent).withColumn("over", (F.lit(cap) > 0) & (spent >= cap)).drop("before")
