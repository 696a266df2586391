"""Intake of files with a quiet time, and results that are kept for a while: keyed state with timers.

Both are given as a stream operator (state and event-time timers) and as the same rule over a whole table. Streams need
a watermark on the column ``at``, and a state store that has timers (``use_state``).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """The session's streams keep their state in a store that has timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _millis(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


def _time(ms: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc).replace(tzinfo=None)


SETTLED = "path string, first timestamp, last timestamp, n long"


class _Debounce(StatefulProcessor):
    """Of each path the times of events that are not settled yet, and whether it was released. A path is released once the watermark has passed the quiet time behind its events: then none can come any more that would belong to them."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<long>")
        self.released = handle.getValueState("released", "released boolean")

    def _burst(self, times: list[int]) -> list[int]:
        """The first times that follow each other within the quiet time."""
        n = 1
        while n < len(times) and times[n] - times[n - 1] <= self.quiet:
            n += 1
        return times[:n]

    def _wake(self, times: list[int]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # one millisecond later: an event just at the end of the quiet time still belongs
        self.handle.registerTimer(self._burst(times)[-1] + self.quiet + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = {_millis(t) for df in rows for t in df["at"]}
        if new and not self.released.exists():
            known = set(self.times.get()[0]) if self.times.exists() else set()
            times = sorted(known | new)
            self.times.update((times,))
            self._wake(times)
        yield pd.DataFrame(columns=["path", "first", "last", "n"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.times.exists() and not self.released.exists():
            burst = self._burst(sorted(self.times.get()[0]))
            out.append((key[0], _time(burst[0]), _time(burst[-1]), len(burst)))
            self.released.update((True,))
            self.times.clear()
        yield pd.DataFrame(out, columns=["path", "first", "last", "n"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_s: int) -> DataFrame:
    """(path, first, last, n) of a stream of (path, at): each file once, when no event of it has come for the quiet time; its later events, and those behind the watermark, are dropped, events of the same time count once. Times are kept to the millisecond."""
    return events.select("path", "at").groupBy("path").transformWithStateInPandas(_Debounce(quiet_s * 1000), SETTLED, "Append", "EventTime")


def settled(events: DataFrame, quiet_s: int) -> DataFrame:
    """The same of a whole table. Bursts are merged from partial ones, so a path of many events doesn't meet in one list."""
    # a session takes in an event just at its end
    session = F.session_window("at", f"{quiet_s} seconds")
    once = events.select("path", F.timestamp_millis(F.unix_millis(F.col("at").cast("timestamp"))).alias("at")).distinct()
    bursts = once.groupBy("path", session).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    return bursts.groupBy("path").agg(F.min_by(F.struct("first", "last", "n"), "first").alias("b")).select("path", "b.*")


ANSWERS = "key string, at timestamp, outcome string, value string"
PUT, GET = "put", "get"


class _Kept(StatefulProcessor):
    """Of each key the result that is kept, and the events that the watermark has not passed yet. Events are answered in the order of their times, by timers."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "events array<struct<at long, kind string, value string>>")
        self.now = handle.getValueState("now", "put long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(_millis(a), k, v or "") for df in rows for a, k, v in zip(df["at"], df["kind"], df["value"], strict=True)]
        old = [tuple(e) for e in self.waiting.get()[0]] if self.waiting.exists() else []
        self.waiting.update((old + new,))
        for t in {e[0] for e in new}:
            self.handle.registerTimer(t)
        yield pd.DataFrame(columns=["key", "at", "outcome", "value"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, out = expiredTimerInfo.getExpiryTimeInMs(), []
        waiting = [tuple(e) for e in self.waiting.get()[0]] if self.waiting.exists() else []
        put, value = self.now.get() if self.now.exists() else (None, None)
        due = sorted((e for e in waiting if e[0] <= until), key=lambda e: (e[0], e[1] != PUT, e[2]))
        for at, kind, said in [*due, (until, None, None)]:
            if put is not None and put + self.ttl <= at:
                out.append((key[0], _time(put + self.ttl), "expired", value))
                put, value = None, None
            if kind == PUT:
                put, value = at, said
                self.handle.registerTimer(at + self.ttl)
            elif kind == GET:
                out.append((key[0], _time(at), "hit" if put is not None else "miss", value))
        if len(due) < len(waiting):
            self.waiting.update(([e for e in waiting if e[0] > until],))
        elif waiting:
            self.waiting.clear()
        if put is not None:
            self.now.update((put, value))
        elif self.now.exists():
            self.now.clear()
        yield pd.DataFrame(out, columns=["key", "at", "outcome", "value"])

    def close(self) -> None:
        pass


def kept(events: DataFrame, ttl_s: int = 3600) -> DataFrame:
    """K5: (key, at, outcome, value) of a stream of (key, at, kind, value): a put keeps its value for the lifetime, a newer one in its place; a get is a hit with that value or a miss; a value that no newer one took the place of expires. Of puts at one time the one with the greatest value counts, and it counts for gets of that time."""
    return events.select("key", "at", "kind", "value").groupBy("key").transformWithStateInPandas(_Kept(ttl_s * 1000), ANSWERS, "Append", "EventTime")


def kept_in(events: DataFrame, until, ttl_s: int = 3600) -> DataFrame:
    """The same of a whole table, with what has expired until a time. A key's events are cut into stretches as long as a lifetime, each with the last put of the stretch before, so that a key of many events is no one task's work."""
    ttl = ttl_s * 1000
    e = events.select("key", F.unix_millis(F.col("at").cast("timestamp")).alias("t"), "kind", F.coalesce("value", F.lit("")).alias("value")).withColumn("s", F.floor(F.col("t") / ttl))
    last = e.where(F.col("kind") == PUT).groupBy("key", "s").agg(F.max(F.struct("t", "value")).alias("p"))
    carried = last.select("key", F.col("p.t").alias("t"), F.lit("carried").alias("kind"), F.col("p.value").alias("value"), (F.col("s") + 1).alias("s"))
    every = e.unionByName(carried).withColumn("p", F.when(F.col("kind") != GET, F.struct("t", "value")))
    before = Window.partitionBy("key", "s").orderBy("t", (F.col("kind") == GET).cast("int"), "value").rowsBetween(Window.unboundedPreceding, 0)
    got = every.withColumn("now", F.max("p").over(before)).where(F.col("kind") == GET)
    alive = F.coalesce(F.col("now.t") + ttl > F.col("t"), F.lit(False))
    answers = got.select("key", F.timestamp_millis("t").alias("at"), F.when(alive, "hit").otherwise("miss").alias("outcome"), F.when(alive, F.col("now.value")).alias("value"))
    # a put expires unless another one comes within its lifetime: in its own stretch or as the first of the next
    puts = e.where(F.col("kind") == PUT).groupBy("key", "s", "t").agg(F.max("value").alias("value"))
    first = puts.groupBy("key", (F.col("s") - 1).alias("s")).agg(F.min("t").alias("next"))
    ahead = Window.partitionBy("key", "s").orderBy("t")
    ends = puts.withColumn("then", F.lead("t").over(ahead)).join(first, ["key", "s"], "left").withColumn("then", F.coalesce("then", "next"))
    over = ends.where((F.col("then").isNull() | (F.col("then") >= F.col("t") + ttl)) & (F.timestamp_millis(F.col("t") + ttl) <= until))
    return answers.unionByName(over.select("key", F.timestamp_millis(F.col("t") + ttl).alias("at"), F.lit("expired").alias("outcome"), "value"))
