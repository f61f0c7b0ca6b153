"""Calls of a chat service in their order, and streams of answers that surely end."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL = ("service", "call_id", "subject", "ts", "cache_key", "estimated", "tokens", "ok", "blocked", "use_cache")
SERVED = "service string, call_id long, status string, billed long, used long, remaining long"
DAY = 86_400_000_000


def calls_of(calls: DataFrame) -> DataFrame:
    """The columns that a service looks at; micros is ts as a number. Missing flags are false, a missing use_cache is true."""
    kinds = {"service": "string", "call_id": "long", "subject": "string", "ts": "timestamp", "cache_key": "string", "estimated": "long", "tokens": "long", "ok": "boolean", "blocked": "boolean", "use_cache": "boolean"}
    plain = {c: F.coalesce(F.col(c).cast(k), F.lit(c == "use_cache")) if k == "boolean" else F.col(c).cast(k) for c, k in kinds.items()}
    return calls.select(*[x.alias(c) for c, x in plain.items()]).withColumn("micros", F.unix_micros("ts"))


def step(call: dict, limit: int, ttl: int, expires: Callable, keep: Callable, used: Callable, add: Callable) -> tuple[str, int, int | None]:
    """One call: status, tokens billed and tokens that its subject has used that day. The four functions read and write the state.

    The order decides what is billed: a guarded call goes first, then one that its estimate puts over the day's limit, even
    where the cache has its answer. The cache answers for nothing. Only a call that succeeds is billed, for what it took, and
    its answer is kept.
    """
    if call["blocked"]:
        return "blocked", 0, None
    day = call["micros"] // DAY
    so_far = used(call["subject"], day)
    if so_far + call["estimated"] > limit:
        return "quota_exceeded", 0, so_far
    filled_until = expires(call["cache_key"]) if call["use_cache"] else None
    if filled_until is not None and call["micros"] < filled_until:
        return "cached", 0, so_far
    if not call["ok"]:
        return "failed", 0, so_far
    billed = max(0, call["tokens"] or 0)
    if billed:
        add(call["subject"], day, billed)
    if call["use_cache"]:
        keep(call["cache_key"], call["micros"] + ttl)
    return "called", billed, so_far + billed


def served(calls: DataFrame, limit: int, ttl_seconds: int) -> DataFrame:
    """service, call_id, status, billed, used, remaining (null for blocked calls). calls: the columns of CALL.

    A service is one cache and one table of quotas by subject and day (UTC), so its calls pass in order of time, then
    call_id, through one state; services are dealt over tasks. A task holds the live answers' keys and the day's subjects of
    one service, never its calls.
    """
    ttl = ttl_seconds * 1_000_000

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache, line, quota, day = object(), {}, deque(), {}, None
        for batch in batches:
            out = []
            for call in batch.to_pylist():
                if call["service"] != now:
                    now, cache, line, quota, day = call["service"], {}, deque(), {}, None
                if call["micros"] // DAY != day:
                    quota, day = {}, call["micros"] // DAY
                while line and line[0][0] <= call["micros"]:
                    if cache.get(line[0][1]) == line[0][0]:
                        del cache[line[0][1]]
                    line.popleft()

                def keep(key: str, until: int, cache: dict = cache, line: deque = line) -> None:
                    cache[key] = until
                    line.append((until, key))

                def add(subject: str, _: int, tokens: int, quota: dict = quota) -> None:
                    quota[subject] = quota.get(subject, 0) + tokens

                status, billed, used = step(call, limit, ttl, cache.get, keep, lambda s, _, quota=quota: quota.get(s, 0), add)
                out.append((call["service"], call["call_id"], status, billed, used, None if used is None else max(0, limit - used)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SERVED.split(", ")])

    return calls_of(calls).drop("ts").repartition("service").sortWithinPartitions("service", "micros", "call_id").mapInArrow(f, SERVED)


PIECES = ("run_id", "sequence", "ts", "type", "delta", "code")
STREAMED = "run_id long, sequence long, type string, code string, delta string, ts timestamp, first_token_ms double, elapsed_ms double, chunk_count long, content string"
TIMEOUT = "stream_timeout"


def _ms(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1000


def streamed(pieces: DataFrame, silence: timedelta, as_of: datetime | None = None) -> DataFrame:
    """Events of answer streams: message_start, tokens, then message_done or error, and always done. pieces: the columns of PIECES.

    A piece is a token (empty ones don't count), an end, or an error with its code. A run that is silent for longer than
    silence, and not ended, has an error stream_timeout and done after that time; what comes later is of no run any more.
    as_of: how far time has gone (else past every silence): runs that may still go on have no end yet. Sequences count from 1
    and have no gaps; the last two events have the times to the first token and from the start, the tokens and the content.
    """
    micros = int(silence.total_seconds() * 1_000_000)
    order = Window.partitionBy("run_id").orderBy("ts", "sequence")
    p = pieces.select(F.col("run_id").cast("long").alias("run_id"), "sequence", F.col("ts").cast("timestamp").alias("ts"), "type", F.coalesce("delta", F.lit("")).alias("delta"), "code")
    late = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > micros
    over = F.coalesce(late | F.lag("type").over(order).isin("end", "error"), F.lit(False))
    p = p.withColumn("over", over.cast("int")).withColumn("gone", F.max("over").over(order)).where("gone = 0").drop("over", "gone")
    token = (F.col("type") == "token") & (F.col("delta") != "")
    r = p.groupBy("run_id").agg(
        F.min("ts").alias("began"), F.min(F.when(token, F.col("ts"))).alias("first"), F.count_if(token).alias("chunk_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(token, F.struct("ts", "sequence", "delta")))), lambda x: x["delta"]), "").alias("content"),  # one answer
        F.max(F.struct("ts", "sequence", "type", "code")).alias("last"),
    )
    shut = F.col("last.type").isin("end", "error")
    at = F.when(shut, F.col("last.ts")).otherwise(F.timestamp_micros(F.unix_micros("last.ts") + micros))
    ends = F.lit(True) if as_of is None else shut | (at <= F.lit(as_of))
    r = r.withColumns({"at": at, "ends": ends, "code": F.when(F.col("last.type") == "error", F.col("last.code")).when(F.col("last.type") != "end", F.lit(TIMEOUT))})
    none, text = F.lit(None), F.lit(None).cast("string")
    tokens = p.where(token).select("run_id", F.lit(1).alias("stage"), "ts", F.col("sequence").alias("n"), F.lit("token").alias("type"), text.alias("code"), "delta", none.cast("double").alias("first_token_ms"), none.cast("double").alias("elapsed_ms"), none.cast("long").alias("chunk_count"), text.alias("content"))

    def event(stage: int, when: str, kind: Column, code: Column, summed: bool) -> DataFrame:
        of = [_ms("first", "began"), _ms("at", "began"), F.col("chunk_count")] if summed else [none.cast("double"), none.cast("double"), none.cast("long")]
        rows = r.where("ends") if summed else r
        return rows.select("run_id", F.lit(stage).alias("stage"), F.col(when).alias("ts"), F.lit(0).alias("n"), kind.alias("type"), code.alias("code"), text.alias("delta"), of[0].alias("first_token_ms"), of[1].alias("elapsed_ms"), of[2].alias("chunk_count"), (F.col("content") if summed else text).alias("content"))

    all_events = tokens.unionByName(event(0, "began", F.lit("message_start"), text, False)).unionByName(event(2, "at", F.when(F.col("code").isNull(), "message_done").otherwise("error"), F.col("code"), True)).unionByName(event(3, "at", F.lit("done"), text, True))
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("stage", "ts", "n"))
    return all_events.withColumn("sequence", number.cast("long")).select([c.split()[0] for c in STREAMED.split(", ")])
