"""Continuous forms of the operators (survey section 2.13).

Each takes a streaming DataFrame and gives one; the column functions are those of the batch
operators. State is bounded by watermarks; rows later than the watermark are dropped and show up
in the query's progress.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from probatio.config import ScoringConfig, UsageLimits
from probatio.operators.ai_tables import RATE_MAX, rate_step
from probatio.plans.scored import scored


def timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on an event-time column; times without zone are read in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def stream_ingest(ev: DataFrame, cfg: ScoringConfig = ScoringConfig(), rules: list | None = None) -> DataFrame:
    """Arriving files with hash, category and scores; stateless, the batch plan as it is."""
    return scored(ev, cfg, rules)


def stream_dedup(ev: DataFrame, arrival: str | None = None, delay: str = "1 day") -> DataFrame:
    """First arrival of each hash within the watermark.

    The watermark follows arrival, by default the time of the batch that reads a file, so no file is
    too old to come out. Unlike the batch search, a copy that arrives later than ``delay`` after its
    original counts as new: hashes are not kept for ever.
    """
    seen = ev.where(F.coalesce("file_hash", F.lit("")) != "")
    if arrival is None:
        seen, arrival = seen.withColumn("arrival_ts", F.current_timestamp()), "arrival_ts"
    return timed(seen, arrival, delay).dropDuplicatesWithinWatermark(["file_hash"])


def stream_periods(events: DataFrame, period: str = "1 day", delay: str = "1 hour", busy: int = 3) -> DataFrame:
    """Events per period and kind, and whether that is high activity."""
    return (timed(events, "ts", delay).groupBy(F.window("ts", period).alias("w"), "event_type")
            .agg(F.count("*").alias("events"), F.sum("value").alias("total"))
            .select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "event_type", "events",
                    "total", (F.col("events") >= busy).alias("high_activity")))


def stream_months(events: DataFrame, delay: str = "1 hour", busy: int = 3) -> DataFrame:
    """W03 by calendar month, for update mode: a month's row is replaced whenever it grows."""
    return (timed(events, "ts", delay).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type")
            .agg(F.count("*").alias("events")).withColumn("high_activity", F.col("events") >= busy))


def stream_sessions(events: DataFrame, key: str = "user_id", gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Clusters of activity per key with at most ``gap`` between events."""
    return (timed(events, "ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key)
            .agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .select(key, "first_ts", "last_ts", "events"))


def stream_usage(usage: DataFrame, limits: UsageLimits = UsageLimits(), length: str = "1 hour", step: str = "10 minutes",
                 delay: str = "1 hour") -> DataFrame:
    """Sliding totals per key with an over-limit flag (an approximation of the exact batch windows)."""
    out = (timed(usage, "ts", delay).groupBy(F.window("ts", length, step).alias("w"), "usage_key")
           .agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")))
    over = (F.col("tokens") >= limits.tokens_per_hour) | (F.round("cost", 9) >= limits.cost_per_hour) \
        | (F.col("requests") >= limits.requests_per_minute * F.lit(pd.Timedelta(length).total_seconds() / 60))
    return out.select(F.col("w.start").alias("window_start"), "usage_key", "requests", "tokens", "cost", over.alias("over_limit"))


STORE = "spark.sql.streaming.stateStore.providerClass"


#: Waiting requests that one row of the state holds at most.
WAITING = 4096


class RateState(StatefulProcessor):
    """Rate of one key: three numbers, and the requests that wait for the watermark as rows of a map.

    A row of the map holds up to ``WAITING`` requests that came together, in order of time, as a call of the state store takes
    far longer than a request. A batch writes what arrives and sets a timer for the earliest of it. When the watermark
    passes a timer, the requests it has passed are folded in order of time and forgotten, a row that it has passed in
    part is written anew with the rest, and the earliest of the rest has the next timer. Of requests equal in time
    and number the last to arrive counts.
    After ``keep_ms`` without requests a key's rate starts anew, and its state ends.
    """

    def __init__(self, keep_ms: int, waiting: int = WAITING):
        self.keep_ms, self.size = keep_ms, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rate = handle.getValueState("rate", "multiplier double, errors bigint, last_ms bigint")
        self.arrived = handle.getValueState("arrived", "blocks bigint")
        self.waiting = handle.getMapState("waiting", "no bigint", "us array<bigint>, request array<bigint>, success array<boolean>")

    def _wake(self, us: int, mark: int) -> None:
        """A timer at the first millisecond by which this time has passed; one that is past is due next."""
        self.handle.registerTimer(max(-(-us // 1000), mark + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, no = None, self.arrived.get()[0] if self.arrived.exists() else 0
        for batch in rows:
            us = batch["ts"].astype("datetime64[us]").astype("int64")
            batch = batch.assign(us=us, success=batch["success"].map(bool)).sort_values("us", kind="stable")
            for at in range(0, len(batch), self.size):
                part = batch.iloc[at:at + self.size]
                self.waiting.updateValue((no,), (part["us"].tolist(), part["request_id"].tolist(), part["success"].tolist()))
                no += 1
            if len(batch):
                first = min([int(us.min()), *([] if first is None else [first])])
        if first is not None:
            self.arrived.update((no,))
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"usage_key": [], "request_id": [], "multiplier": []}).astype(RATE_TYPES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        multiplier, errors, last = self.rate.get() if self.rate.exists() else (RATE_MAX, 0, None)
        passed, rest = [], None
        for (no,), (times, requests, oks) in self.waiting.iterator():
            done = bisect_right(times, mark * 1000)
            if done:
                passed.append((no, done, times, requests, oks))
            if done < len(times):
                rest = times[done] if rest is None else min(rest, times[done])
        due, out = {}, []
        for no, done, times, requests, oks in sorted(passed):  # by arrival
            due.update(zip(zip(times[:done], requests[:done]), oks[:done]))
            if done < len(times):
                self.waiting.updateValue((no,), (times[done:], requests[done:], oks[done:]))
            else:
                self.waiting.removeKey((no,))
        for us, request in sorted(due):
            if last is not None and us // 1000 - last > self.keep_ms:
                multiplier, errors = RATE_MAX, 0
            multiplier, errors = rate_step(multiplier, int(errors), due[us, request])
            last = us // 1000
            out.append((request, multiplier))
        if due:
            self.rate.update((multiplier, errors, last))
            self.handle.registerTimer(max(last + self.keep_ms, mark) + 1)
        elif rest is None and last is not None and mark - last > self.keep_ms:
            self.rate.clear()
            self.arrived.clear()
        if rest is not None:
            self._wake(rest, mark)
        yield pd.DataFrame({"usage_key": [key[0]] * len(out), "request_id": [r for r, _ in out],
                            "multiplier": [m for _, m in out]}).astype(RATE_TYPES)

    def close(self) -> None:
        pass


RATE_TYPES = {"usage_key": "int64", "request_id": "int64", "multiplier": "float64"}


def stream_rate_state(usage: DataFrame, delay: str = "1 hour", keep: str = "7 days", waiting: int = WAITING) -> DataFrame:
    """Rate multiplier of each key after each request, in order of time.

    A request comes out once the watermark (latest time less ``delay``) has passed it, so requests
    that arrive up to ``delay`` late are folded in their place; later ones are dropped and counted in
    the query's progress. Waiting requests are rows of a map in the state store, up to ``waiting`` in one, so a batch writes only what
    is new; the state of a key ends after ``keep`` without requests. Such state needs the RocksDB store,
    which is set here for the queries that the session starts from now on.
    """
    conf = usage.sparkSession.conf
    if not conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = timed(usage.select("usage_key", "request_id", "ts", "success"), "ts", delay)
    return rows.groupBy("usage_key").transformWithStateInPandas(
        RateState(keep_ms, waiting), "usage_key bigint, request_id bigint, multiplier double", "append", "eventtime")
