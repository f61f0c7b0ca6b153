"""Conversations and usage over time: history windows, token budgets, quotas, rate limits, caches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import estimate_tokens_mixed, strip


def _turns() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def _latest_first() -> WindowSpec:
    return Window.partitionBy("conv_id", "is_system").orderBy(F.desc("turn"))


def _marked(messages: DataFrame) -> DataFrame:
    return messages.withColumn("is_system", F.col("role") == "system")


def recent(messages: DataFrame, n: int) -> DataFrame:
    """All system messages and the last n others. messages: conv_id, turn, role, text."""
    return _marked(messages).withColumn("back", F.row_number().over(_latest_first())).where(F.col("is_system") | (F.col("back") <= n)).drop("is_system", "back")


def buffered(messages: DataFrame, most: int) -> DataFrame:
    """A rolling buffer of so many messages after its last one: texts stripped, blanks left out; the first system message and the last others.

    With room for just the system message the buffer keeps every other message since it was last short enough: a slice
    of the last none is a slice of all. That quirk is kept.
    """
    m = _marked(messages.withColumn("text", strip("text")).where("text != ''"))
    first = F.row_number().over(Window.partitionBy("conv_id", "is_system").orderBy("turn"))
    m = m.withColumn("back", F.row_number().over(_latest_first())).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).withColumn("first", first)
    m = m.withColumn("systems", F.max(F.col("is_system").cast("int")).over(Window.partitionBy("conv_id")))
    room = F.greatest(F.lit(most) - F.col("systems"), F.lit(0))
    keep = F.when(F.col("n") <= most, True).when(F.col("is_system"), F.col("first") == 1).otherwise((room == 0) | (F.col("back") <= room))
    return m.where(keep).select(messages.columns)


def message_cost(role: str = "role", text: str = "text") -> Column:
    return estimate_tokens_mixed(role) + estimate_tokens_mixed(text) + 4


def conversation_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg((F.sum(message_cost()) + 2).alias("tokens"))


def within_budget(messages: DataFrame, budget: int) -> DataFrame:
    """System messages and the latest others that fit the budget together; the first that doesn't ends it."""
    m = _marked(messages).withColumn("cost", message_cost())
    m = m.withColumn("system_cost", F.sum(F.when(F.col("is_system"), F.col("cost")).otherwise(0)).over(Window.partitionBy("conv_id")))
    m = m.withColumn("running", F.sum("cost").over(_latest_first()))  # costs are positive, so what fits is a run of the latest
    return m.where(F.col("is_system") | (F.col("running") + F.col("system_cost") + 2 <= budget)).select(messages.columns)


def running_totals(messages: DataFrame) -> DataFrame:
    return messages.withColumn("turn_number", F.row_number().over(_turns())).withColumn("total_tokens", F.sum(message_cost()).over(_turns()))


def daily_quota(usage: DataFrame, limit: int) -> DataFrame:
    """subject, day, used, remaining, exceeded. usage: subject, ts, tokens; negative tokens count as none."""
    u = usage.groupBy("subject", F.to_date("ts").alias("day")).agg(F.sum(F.greatest("tokens", F.lit(0))).alias("used"))
    return u.select("subject", "day", "used", F.greatest(F.lit(0), limit - F.col("used")).alias("remaining"), (F.col("used") >= limit).alias("exceeded"))


def quota_decisions(usage: DataFrame, limit: int, order: str = "event_id") -> DataFrame:
    """usage with allowed: whether its tokens still fit its subject's day, all earlier ones counted."""
    before = Window.partitionBy("subject", F.to_date("ts")).orderBy("ts", order).rowsBetween(Window.unboundedPreceding, -1)
    return usage.withColumn("used_before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("allowed", F.col("used_before") + F.col("tokens") <= limit)


def rate_limited(calls: DataFrame, most: int, order: str = "event_id") -> DataFrame:
    """calls with rejected: more than so many of the key came before."""
    return calls.withColumn("rejected", F.row_number().over(Window.partitionBy("key").orderBy("ts", order)) > most)


def exact_cache(calls: DataFrame, order: str = "event_id") -> DataFrame:
    """calls with hit: an identical key came before."""
    return calls.withColumn("hit", F.row_number().over(Window.partitionBy("key").orderBy("ts", order)) > 1)


def ttl_cache(calls: DataFrame, seconds: int, order: str = "event_id") -> DataFrame:
    """calls with hit: a miss less than so many seconds before filled the cache. A hit doesn't lengthen it.

    calls: key, ts. Each key's calls pass in order by a state of one time, so no key is ever held whole.
    """
    timed = calls.withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp")))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, filled = None, None
        for batch in batches:
            hits = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("__t").to_pylist(), strict=True):
                hit = k == key and t < filled + seconds * 1_000_000
                if not hit:
                    key, filled = k, t
                hits.append(hit)
            yield batch.append_column("hit", pa.array(hits, pa.bool_()))

    schema = T.StructType([*timed.schema.fields, T.StructField("hit", T.BooleanType())])
    return timed.repartition("key").sortWithinPartitions("key", "__t", order).mapInArrow(f, schema).drop("__t")


def final_attempts(attempts: DataFrame) -> DataFrame:
    """request_id, attempts, and of the last one config and ok. attempts: request_id, sequence, config_ref, ok."""
    return attempts.groupBy("request_id").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("config_ref", "sequence").alias("config_ref"), F.max_by("ok", "sequence").alias("ok"))
