"""Stateful streams: a service's calls in their order, and answer streams with a guaranteed end.

Both need the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as all processors of many state variables do.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from granary.operators.service import DAY, SERVED, STREAMED, TIMEOUT, calls_of, step

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ServiceOrder(StatefulProcessor):
    """The state of one service: until when its answers are kept, and what subjects have used, by day."""

    def __init__(self, limit: int, ttl_seconds: int) -> None:
        self.limit, self.ttl = limit, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cache = handle.getMapState("cache", "cache_key string", "until long")
        self.quota = handle.getMapState("quota", "subject string, day long", "used long")

    def _used(self, subject: str, day: int) -> int:
        found = self.quota.getValue((subject, day))
        return found[0] if found else 0

    def _expires(self, key: str) -> int | None:
        found = self.cache.getValue((key,))
        return found[0] if found else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["micros", "call_id"])
        out = []
        for call in calls.to_dict("records"):
            call = {c: None if pd.isna(x) else x for c, x in call.items()}
            call |= {c: int(call[c]) for c in ("micros", "estimated", "tokens") if call[c] is not None}
            status, billed, used = step(call, self.limit, self.ttl, self._expires, lambda k, until: self.cache.updateValue((k,), (until,)), self._used, lambda s, day, n: self.quota.updateValue((s, day), (self._used(s, day) + n,)))
            out.append((key[0], call["call_id"], status, billed, used, None if used is None else max(0, self.limit - used)))
        self.handle.registerTimer((int(calls["micros"].max()) + max(self.ttl, DAY)) // 1000)
        yield _frame(out, SERVED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Answers that have run out and days that are over leave the state."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for k in [k for k, (until,) in self.cache.iterator() if until <= now]:
            self.cache.removeKey(k)
        for k in [k for k in self.quota.keys() if (k[1] + 1) * DAY <= now]:
            self.quota.removeKey(k)
        yield from ()

    def close(self) -> None:
        pass


def served(calls: DataFrame, limit: int, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """operators.service.served over a stream. Calls of a batch pass in order of time; those of later batches after them.

    A service's state is its live answers and days: a timer clears them once the watermark is a time to live, and at least a
    day, past its last call.
    """
    from pyspark.sql.functions import col

    timed = calls_of(calls).where(col("micros").isNotNull()).withWatermark("ts", late)
    return timed.groupBy("service").transformWithStateInPandas(ServiceOrder(limit, ttl_seconds), SERVED, "Append", "EventTime")


class GuaranteedEnd(StatefulProcessor):
    """The state of one run: its times and counts, its parts, and the timer that ends it."""

    def __init__(self, silence: timedelta, keep_for: timedelta) -> None:
        self.silence, self.keep = int(silence.total_seconds() * 1000), int(keep_for.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "began long, first long, last long, chunks long, sequence long, shut boolean")
        self.parts = handle.getListState("parts", "delta string")

    def _end(self, key: tuple, at: int, state: dict, code: str | None) -> list[tuple]:
        """The last two events; the run is shut for a while, so that what comes late finds no open run."""
        content = "".join(x[0] for x in self.parts.get())
        self.parts.clear()
        summed = (None if state["first"] is None else (state["first"] - state["began"]) / 1000, (at - state["began"]) / 1000, state["chunks"], content)
        state["shut"] = True
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at // 1000 + self.keep)
        return [(key[0], state["sequence"] + 1, "message_done" if code is None else "error", code, None, at, *summed), (key[0], state["sequence"] + 2, "done", None, None, at, *summed)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ("began", "first", "last", "chunks", "sequence", "shut")
        state = dict(zip(names, self.run.get(), strict=True)) if self.run.exists() else None
        out, new = [], []
        for kind, delta, code, micros in pd.concat(list(rows)).sort_values(["micros", "sequence"])[["type", "delta", "code", "micros"]].itertuples(index=False):
            micros = int(micros)
            if state and state["shut"]:
                break
            if state and micros - state["last"] > self.silence * 1000:
                self.parts.appendList(new) if new else None
                new = []
                out += self._end(key, state["last"] + self.silence * 1000, state, TIMEOUT)
                break
            if not state:
                state = dict(zip(names, (micros, None, micros, 0, 1, False), strict=True))
                out.append((key[0], 1, "message_start", None, None, micros, None, None, None, None))
            state["last"] = micros
            if kind == "token" and delta:
                state["chunks"] += 1
                state["sequence"] += 1
                state["first"] = micros if state["first"] is None else state["first"]
                new.append((delta,))
                out.append((key[0], state["sequence"], "token", None, delta, micros, None, None, None, None))
            elif kind in ("end", "error"):
                self.parts.appendList(new) if new else None
                new = []
                out += self._end(key, micros, state, None if kind == "end" else code)
        if new:
            self.parts.appendList(new)
        if state:
            self.run.update(tuple(state[n] for n in names))
            if not state["shut"]:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(state["last"] // 1000 + self.silence)
        yield _frame(out, STREAMED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = ("began", "first", "last", "chunks", "sequence", "shut")
        state = dict(zip(names, self.run.get(), strict=True))
        if state["shut"]:
            self.run.clear()  # nothing of the run is left
            return
        out = self._end(key, state["last"] + self.silence * 1000, state, TIMEOUT)
        self.run.update(tuple(state[n] for n in names))
        yield _frame(out, STREAMED)

    def close(self) -> None:
        pass


def streamed(pieces: DataFrame, silence: timedelta, late: str = "1 minute", keep_for: timedelta = timedelta(hours=1)) -> DataFrame:
    """operators.service.streamed over a stream: a timer ends runs that stay silent, once the watermark has passed their time.

    A run that has ended keeps a mark for keep_for, so that late pieces don't open it again, and then leaves the state.
    """
    from pyspark.sql import functions as F

    timed = pieces.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return timed.groupBy(F.col("run_id").cast("long").alias("run_id")).transformWithStateInPandas(GuaranteedEnd(silence, keep_for), STREAMED, "Append", "EventTime")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame whose numbers may be null; times are given in microseconds."""
    kinds = dict(c.split() for c in schema.split(", "))
    made = pd.DataFrame(rows, columns=list(kinds)).astype({c: "Int64" if k == "long" else "Float64" for c, k in kinds.items() if k in ("long", "double")})
    for c in (c for c, k in kinds.items() if k == "timestamp"):
        made[c] = pd.to_datetime(made[c], unit="us", utc=True)
    return made
