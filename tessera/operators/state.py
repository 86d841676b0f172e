"""Sequential state machines: folds over the events of a key, batch and streaming.

A fold's state is a few numbers; its events arrive in batches sorted by time,
so that a key of any length passes through one Python worker in constant
memory. A key is one task's work: sequence is what these operators are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text, url


@dataclass
class Breaker:
    """Opens after so many counted failures in a row; after the reset time one probe decides."""

    failures: int = 5
    reset_s: float = 60.0
    state: str = "closed"
    row: int = 0
    opened: float = 0.0

    def step(self, ts: float, ok: bool, counted: bool) -> tuple[str, str]:
        """('pass' or 'reject', state after) of a call; uncounted errors are successes to the breaker."""
        if self.state == "open" and ts - self.opened >= self.reset_s:
            self.state = "half_open"
        if self.state == "open":
            return "reject", self.state
        if ok or not counted:
            self.row, self.state = 0, "closed"
        else:
            self.row += 1
            if self.state == "half_open" or self.row >= self.failures:
                self.state, self.opened = "open", ts
        return "pass", self.state


@dataclass
class Limiter:
    """At most ``rate`` allowed hits in any window; refused hits cost nothing."""

    rate: int = 3
    window_s: float = 60.0
    hits: list[float] = field(default_factory=list)

    def step(self, ts: float) -> bool:
        self.hits = [t for t in self.hits if ts - t < self.window_s]
        if len(self.hits) >= self.rate:
            return False
        self.hits.append(ts)
        return True


def _fold(df: DataFrame, key: str, id_: str, make: Callable[[], object], step: Callable[[object, pd.Series], tuple], out: str, names: list[str], needed: list[str]) -> DataFrame:
    """Runs of equal keys in partitions that are dealt by key and sorted by time; state lives between batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            rows = batch.to_pylist()
            done = []
            for r in rows:
                if r[key] != current:
                    current, state = r[key], make()
                done.append((r[key], r[id_], *step(state, r)))
            if done:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=[key, id_, *names]), preserve_index=False)

    picked = df.select(F.col(key).cast("string").alias(key), F.col(id_).cast("long").alias(id_), F.col("ts").cast("double").alias("ts"), *needed)
    dealt = picked.repartition(key).sortWithinPartitions(key, "ts", id_)
    return dealt.mapInArrow(work, f"{key} string, {id_} long, {out}")


def breaker(calls: DataFrame, failures: int = 5, reset_s: float = 60.0) -> DataFrame:
    """calls (name, id, ts in seconds, ok, counted) -> (name, id, verdict, state)."""
    return _fold(calls, "name", "id", lambda: Breaker(failures, reset_s), lambda b, r: b.step(r["ts"], r["ok"], r["counted"]), "verdict string, state string", ["verdict", "state"], ["ok", "counted"])


def limiter(hits: DataFrame, rate: int = 3, window_s: float = 60.0) -> DataFrame:
    """hits (key, id, ts in seconds) -> (key, id, allowed)."""
    return _fold(hits, "key", "id", lambda: Limiter(rate, window_s), lambda x, r: (x.step(r["ts"]),), "allowed boolean", ["allowed"], [])


def cooldown(visits: DataFrame, ttl_s: int = 900) -> DataFrame:
    """visits (host, id, ts in seconds, blocked) with whether a block of the same host in the last ttl seconds was on record.

    A window, not a fold: every block marks the host, cooled or not.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("blocked"), F.col("ts"))).over(w)
    return visits.withColumn("cooled", F.coalesce(F.col("ts") - last < ttl_s, F.lit(False)))


RETRY_PAUSES = (0.5, 1.0, 2.0)
GONE = (404, 410)


def fetch_outcome(attempts: DataFrame, tries: int = 3) -> DataFrame:
    """attempts (url_id, attempt from 1, status, empty, blocked) -> (url_id, outcome, used).

    Gone pages and confirmed blocks end it, server errors, 429 and empty bodies
    are tried again, anything else is the result.
    """
    end = (
        F.when(F.col("status").isin(*GONE), "gone").when(F.col("blocked"), "blocked")
        .when((F.col("status") >= 500) | (F.col("status") == 429) | F.col("empty"), F.lit(None)).otherwise("ok")
    )
    seen = attempts.where(F.col("attempt") <= tries).withColumn("end", end)
    first = seen.groupBy("url_id").agg(F.min(F.when(F.col("end").isNotNull(), F.struct("attempt", "end"))).alias("x"), F.max("attempt").alias("last"))
    return first.select("url_id", F.coalesce("x.end", F.lit("failed")).alias("outcome"), F.coalesce("x.attempt", "last").alias("used"))


# Hosts that only a browser can read.
BROWSER_ONLY = ("threads.net", "instagram.com")
TIERS = ("http", "impersonated", "browser")


def fetch_tiers(attempts: DataFrame) -> DataFrame:
    """attempts (url_id, url, tier, status, content_type, content, blocked) -> (url_id, tier, outcome).

    Tiers go from plain HTTP over an impersonated client to a browser, where some
    hosts begin. Gone pages end it at any tier, PDF bodies (for the PDF engines) at the
    first, which ends it also with a readable page, the impersonated
    client with any text, a browser always, 'ok' or 'empty'. Blocked pages and
    other statuses hold no text. Where no tier ended it, tier is null and the
    outcome 'unfinished'.
    """
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    h = url.host(F.col("url"))
    browser_only = functools.reduce(lambda a, b: a | b, [url.host_is(h, s) for s in BROWSER_ONLY])
    readable = F.col("status").between(200, 299) & ~F.coalesce("blocked", F.lit(False))
    said = text.strip(F.when(readable, F.coalesce("content", F.lit(""))).otherwise(F.lit("")))
    is_pdf = F.lower(F.trim(F.substring_index("content_type", ";", 1))) == "application/pdf"
    end = (
        F.when(F.col("status").isin(*GONE), "gone")
        .when(F.coalesce(is_pdf, F.lit(False)) & F.col("status").between(200, 299) & (F.col("tier") == "http"), "pdf")
        .when(F.when(F.col("tier") == "http", ~text.needs_browser(said)).otherwise(said != ""), "ok")
        .when(F.col("tier") == "browser", "empty")
    )
    reached = attempts.where((tier > 0) & (~F.coalesce(browser_only, F.lit(False)) | (F.col("tier") == "browser"))).select("url_id", tier.alias("n"), "tier", end.alias("end"))
    first = reached.where("end IS NOT NULL").groupBy("url_id").agg(F.min(F.struct("n", "end", "tier")).alias("x"))
    return attempts.select("url_id").distinct().join(first, "url_id", "left").select("url_id", F.col("x.tier").alias("tier"), F.coalesce("x.end", F.lit("unfinished")).alias("outcome"))
