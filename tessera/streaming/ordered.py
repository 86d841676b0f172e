"""Folds over a key's events in the order of event time, whatever their order of arrival.

An event waits in its key's state until the watermark has passed it; a timer
then folds all that have become due. What a fold keeps goes by a second timer,
once no later event can be touched by it. Null ids count as -1, null flags as
false, null keys are a key; events without a time are dropped. The batch twins are metrics.held,
state.cooldown and state.limiter. A session needs the RocksDB state store:
``STORE`` holds the setting.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.session import written

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_MS = 1000
#: The time of a row that ends a stream, in microseconds: 2200-01-01. It is no event.
END = 7_258_118_400_000_000

#: Events of one instant, [(id, flag)], after what is kept (a list of numbers, or None) -> what is kept now, an answer for each event.
Fold = Callable[[list | None, int, list[tuple[int, bool]]], tuple[list | None, list[bool]]]


class InOrder(StatefulProcessor):
    """Folds events at their times; ``expires`` tells from what is kept when it may go (microseconds), or None."""

    def __init__(self, fold: Fold, expires: Callable[[list], int | None]):
        self.fold, self.expires = fold, expires

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, flag boolean")
        self.kept = handle.getValueState("kept", "numbers string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:
            new = [(int(a), int(i), bool(f)) for a, i, f in zip(pdf["at"], pdf["id"], pdf["flag"])]
            if new:
                self.waiting.appendList(new)
                last = max(new[-1][0] if last is None else last, max(n[0] for n in new))
        if last is not None:  # all of a batch are due at the latest when its last one is
            self.handle.registerTimer(-(-last // _MS))
        yield pd.DataFrame({"key": pd.Series(dtype="object"), "id": pd.Series(dtype="int64"), "verdict": pd.Series(dtype="bool")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * _MS
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in events if e[0] <= until]
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        out: list[tuple[int, bool]] = []
        k = 0
        while k < len(due) and due[k][0] < END:
            z = k
            while z < len(due) and due[z][0] == due[k][0]:
                z += 1
            state, verdicts = self.fold(state, due[k][0], [(i, f) for _, i, f in due[k:z]])
            out += zip([i for _, i, _ in due[k:z]], verdicts)
            k = z
        if due:
            if len(due) < len(events):
                self.waiting.put(events[len(due):])
            else:
                self.waiting.clear()
        gone = None if state is None else self.expires(state)
        if state is None or (gone is not None and gone <= until):
            self.kept.clear()
        elif due:
            self.kept.update((json.dumps(state),))
            if gone is not None:
                self.handle.registerTimer(-(-gone // _MS))
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="object"), "id": pd.Series([i for i, _ in out], dtype="int64"), "verdict": pd.Series([v for _, v in out], dtype="bool")})

    def close(self) -> None:
        pass


def _fold(events: DataFrame, key: str, flag: str | None, late: str, fold: Fold, expires: Callable[[list], int | None]) -> DataFrame:
    flagged = F.lit(False) if flag is None else F.coalesce(F.col(flag), F.lit(False))
    picked = events.withWatermark("ts", late).select("ts", F.col(key).cast("string").alias("key"), F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"), F.unix_micros("ts").alias("at"), flagged.alias("flag")).where("at IS NOT NULL")
    return picked.groupBy("key").transformWithStateInPandas(InOrder(fold, expires), "key string, id long, verdict boolean", "append", "EventTime")


def ended(events: DataFrame) -> DataFrame:
    """A stream with one more row, of nulls at END: read in one batch with all others, it makes them due, and has no answer itself."""
    spark = events.sparkSession
    last = written(spark.range(1).select(*[(F.timestamp_micros(F.lit(END)) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]))
    return events.unionByName(spark.readStream.schema(last.schema).parquet(last.inputFiles()[0].rsplit("/", 1)[0]))


def held_stream(flags: DataFrame, hold_s: int, late: str = "10 minutes") -> DataFrame:
    """flags (key, id, ts, firing) -> (key, id, verdict): whether the condition held all through the time before.

    Kept are a series' first time and that of its last evaluation that did not
    fire, in seconds; as the first counts for ever, they stay.
    """

    def fold(kept, at, events):
        s = at // 1_000_000
        first, bad = kept or [s, None]
        # evaluations of one second see each other, as in a window by seconds
        if not all(f for _, f in events):
            bad = s
        alert = s - first >= hold_s and (bad is None or bad < s - hold_s)
        return [first, bad], [alert] * len(events)

    return _fold(flags.withColumn("ts", F.date_trunc("second", "ts")), "key", "firing", late, fold, lambda kept: None)


def cooldown_stream(visits: DataFrame, ttl_s: int = 900, late: str = "10 minutes") -> DataFrame:
    """visits (key, id, ts, blocked) -> (key, id, verdict): whether a block in the last ttl seconds was on record.

    A host keeps the time of its last block, for ttl seconds. At one time events go by id.
    """
    ttl = ttl_s * 1_000_000

    def fold(kept, at, events):
        out = []
        for _, blocked in events:
            out.append(kept is not None and at - kept[0] < ttl)
            kept = [at] if blocked else kept
        return kept, out

    return _fold(visits, "key", "blocked", late, fold, lambda kept: kept[0] + ttl)


def limiter_stream(hits: DataFrame, rate: int = 3, window_s: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """hits (key, id, ts) -> (key, id, verdict): at most ``rate`` allowed hits in any window; refused ones cost nothing.

    A key keeps its last ``rate`` allowed times at most, until the newest is a window old.
    """
    window = int(window_s * 1_000_000)

    def fold(kept, at, events):
        kept, out = [t for t in kept or [] if at - t < window], []
        for _ in events:
            out.append(len(kept) < rate)
            if out[-1]:
                kept.append(at)
        return kept or None, out

    return _fold(hits, "key", None, late, fold, lambda kept: kept[-1] + window)
