"""Structured Streaming forms: windowed counts, deduplication, rolling histories, quotas, event rebuilding, log sinks.

Time stamps without zone are cast first: watermarks need an instant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from granary.functions.structured import server_sent_event
from granary.sources.tables import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, directory: str, pattern: str = "events.parquet", schema: str | StructType = EVENTS) -> DataFrame:
    """A stream of the event files in a directory."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(directory).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rolling_history(messages: DataFrame, most: int, keep_for: int | None = None) -> DataFrame:
    """conv_id and its last messages after each batch: the first system message and the latest others. messages: conv_id, turn, role, text, ts.

    A conversation is forgotten once the latest messages of all are keep_for seconds newer than its own, and so are messages that
    come later than that. Without keep_for, the state of all conversations stays.
    """

    def f(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        system, others = (None, []) if not state.exists else (state.get[0], [tuple(x.split("\x1f", 1)) for x in state.get[1]])
        rows = pd.concat(list(batches)).sort_values("turn")
        for role, text in zip(rows["role"], rows["text"].fillna("").str.strip(), strict=True):
            if not text:
                continue
            if role == "system":
                system = system or text
            else:
                others.append((role, text))
        room = max(most - (system is not None), 0)
        others = others[len(others) - room :] if room and len(others) > room else others if room else []
        state.update((system, ["\x1f".join(x) for x in others]))
        if keep_for is not None:
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_for * 1000)
        yield pd.DataFrame({"conv_id": [key[0]], "messages": [[*([f"system: {system}"] if system else []), *(f"{r}: {t}" for r, t in others)]]})

    timeout = GroupStateTimeout.NoTimeout if keep_for is None else GroupStateTimeout.EventTimeTimeout
    timed = messages if keep_for is None else messages.withWatermark("ts", f"{keep_for} seconds")
    return timed.groupBy("conv_id").applyInPandasWithState(f, "conv_id long, messages array<string>", "system string, others array<string>", "update", timeout)


def running_quota(usage: DataFrame, limit: int, late: str = "2 days") -> DataFrame:
    """subject, day, used, exceeded: totals so far. usage: subject, ts, tokens. Days that end more than late before the last event leave the state, but in complete mode."""
    u = usage.withWatermark("ts", late).groupBy("subject", F.window("ts", "1 day").alias("w")).agg(F.sum(F.greatest("tokens", F.lit(0))).alias("used"))
    return u.select("subject", F.to_date("w.start").alias("day"), "used", (F.col("used") >= limit).alias("exceeded"))


def sse_lines(events: DataFrame) -> DataFrame:
    """Server-sent events. events: run_id, sequence, type, and what else goes into the data."""
    return events.select(server_sent_event(F.col("run_id").cast("string"), F.col("sequence").cast("string"), F.col("type"), F.to_json(F.struct(*events.columns))).alias("value"))


def stream_guard(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Events of the requests that may not be streamed: an error, then done. requests: run_id, config_ref; models: config_ref, role, streaming (null: not known).

    Requests of configurations that may stream have no rows here; nor have those of configurations that there aren't.
    """
    m = requests.join(models, "config_ref").withColumn("message", F.when(F.col("role") != "chat", F.concat("config_ref", F.lit(" is for "), "role", F.lit(", not for chat"))).when(~F.col("streaming"), F.concat("config_ref", F.lit(" can't stream"))))
    error = F.struct(F.lit(1).alias("sequence"), F.lit("error").alias("type"), F.lit("capability_mismatch").alias("code"), F.col("message").alias("message"))
    done = F.struct(F.lit(2).alias("sequence"), F.lit("done").alias("type"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"))
    return m.where("message is not null").select("run_id", "config_ref", F.explode(F.array(error, done)).alias("e")).select("run_id", "e.*", "config_ref")


def write_logs(batch: DataFrame, out: str, errors: str) -> None:
    """A foreachBatch sink of JSON lines: warnings and errors apart from the rest. batch: level and fields."""
    bad = F.col("level").isin("WARNING", "ERROR")
    batch.where(~bad).write.mode("append").json(out)
    batch.where(bad).write.mode("append").json(errors)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a finite stream gives, as a table: written by its tasks to a shared folder, with its state, and read back. In complete mode that is what the last batch gave."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "streams")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")  # there is a table even without a batch
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out").select(stream.columns)
