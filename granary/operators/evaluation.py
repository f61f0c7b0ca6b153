"""Evaluation: retrieval metrics, answer checks, experiment comparison, run, cost and cache summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import without_space


def retrieval_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, recall, rr, hit. results: case_id, chunk_id, rank; expected: case_id, chunk_id."""
    e = expected.select("case_id", "chunk_id").distinct()
    r = results.select(F.col("case_id").alias("_case"), F.col("chunk_id").alias("_chunk"), "rank")
    met = e.join(r, (F.col("case_id") == F.col("_case")) & (F.col("chunk_id") == F.col("_chunk")), "left")  # each side is made once
    both = met.groupBy("case_id").agg(F.count_distinct(F.struct("chunk_id")).alias("wanted"), F.count_distinct("_chunk").alias("found"), F.min("rank").alias("first"))
    rr = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return both.select("case_id", (F.col("found") / F.col("wanted")).alias("recall"), rr.alias("rr"), F.when(rr > 0, 1.0).otherwise(0.0).alias("hit"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("hit").alias("hit_rate"), F.count(F.lit(1)).alias("cases"))


def answer_point_recall(points: Column, answer: Column) -> Column:
    a = without_space(answer)
    found = F.size(F.filter(F.transform(points, without_space), lambda p: F.contains(a, p)))
    return F.when(F.size(points) > 0, found / F.size(points)).otherwise(1.0)


def source_recall(expected: Column, actual: Column) -> Column:
    return F.when(F.size(expected) > 0, F.size(F.filter(expected, lambda s: F.array_contains(actual, s))) / F.size(expected)).otherwise(1.0)


def failure_stage(should_refuse: Column, refusal_correct: Column, has_target: Column, hit: Column, sources: Column, labels: Column, points: Column) -> Column:
    """Where an answered case went wrong, first stage first."""
    return (
        F.when(~refusal_correct, "refusal_boundary")
        .when(should_refuse, "pass")
        .when(has_target & (hit == 0), "retrieval")
        .when(sources < 1, "citation_alignment")
        .when(F.size(labels) == 0, "citation_format")
        .when(points < 1, "answer_quality")
        .otherwise("pass")
    )


def rag_report(cases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the cases that each metric is about; none is 0.

    cases: should_refuse, has_target, recall, rr, hit, point_recall, source_recall, citation_support, refusal_correct, stage.
    """
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0))
    target, answered, refused = F.col("has_target"), ~F.col("should_refuse"), F.col("should_refuse")
    out = cases.withColumn("refusal", F.col("refusal_correct").cast("double")).withColumn("passed", (F.col("stage") == "pass").cast("double"))
    return out.groupBy(*by).agg(
        mean("recall", target).alias("retrieval_recall"), mean("rr", target).alias("retrieval_mrr"), mean("hit", target).alias("retrieval_hit_rate"),
        mean("point_recall", answered).alias("answer_point_recall"), mean("source_recall", answered).alias("source_hit_rate"), mean("citation_support", answered).alias("citation_support_rate"),
        mean("refusal", refused).alias("refusal_accuracy"), F.coalesce(F.avg("passed"), F.lit(0.0)).alias("pass_rate"),
        F.count(F.lit(1)).alias("case_count"), F.count_if(answered).alias("answerable_case_count"), F.count_if(refused).alias("refusal_case_count"),
    )


#: Fixed weights of the composite score.
COMPOSITE = {"retrieval_recall": 0.20, "retrieval_mrr": 0.10, "answer_point_recall": 0.20, "source_hit_rate": 0.15, "citation_support_rate": 0.15, "refusal_accuracy": 0.10, "pass_rate": 0.10}


def compare_experiments(cases: DataFrame) -> DataFrame:
    """One row a config_id, best composite first."""
    report = rag_report(cases, ("config_id",))
    score = sum((F.col(c) * w for c, w in COMPOSITE.items()), F.lit(0.0))
    return report.withColumn("composite_score", score).orderBy(F.desc("composite_score"), F.desc("pass_rate"), "config_id")


def run_summary(runs: DataFrame, *by: str) -> DataFrame:
    """runs: ok, parse_ok, degraded, latency_ms, prompt_tokens, completion_tokens, total_tokens, cost, cache_hit. No known cost gives null."""
    known = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(c)
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failed_count"), F.count_if("parse_ok").alias("parse_success_count"), F.count_if("degraded").alias("degraded_count"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("average_latency_ms"), F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_latency_ms"),
        known("prompt_tokens"), known("completion_tokens"), known("total_tokens"), F.sum("cost").alias("estimated_total_cost"), F.count_if("cache_hit").alias("cache_hit_count"),
    )


def error_counts(runs: DataFrame) -> DataFrame:
    return runs.where("error_code is not null").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


def cache_summary(events: DataFrame, *by: str) -> DataFrame:
    """events: hit, saved_tokens, saved_cost, saved_latency_ms."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hit_count"), F.count_if(~F.col("hit")).alias("miss_count"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
        F.sum("saved_cost").alias("saved_estimated_cost"), F.coalesce(F.sum("saved_latency_ms"), F.lit(0.0)).alias("saved_latency_ms"),
        F.coalesce(F.count_if("hit") / F.count(F.lit(1)), F.lit(0.0)).alias("hit_rate"),
    )


#: Fixed learning prices: input and output price of a million tokens, and a label.
PRICES = (
    ("chat.dev_chat", 0.15, 0.60, "learning_low"),
    ("chat.fallback_chat", 0.15, 0.60, "learning_low"),
    ("chat.structured_chat", 2.50, 10.00, "learning_medium"),
    ("gpt-4o-mini", 0.15, 0.60, "learning_low"),
    ("gpt-4o", 2.50, 10.00, "learning_medium"),
    ("fake-model", 0.15, 0.60, "learning_fake"),
)


def priced(usage: DataFrame, prices: tuple = PRICES) -> DataFrame:
    """usage with input_cost, output_cost, total_cost, price_label: by config_ref, else by model; unknown prices and usage give null."""
    table = F.map_from_arrays(F.array(*[F.lit(p[0]) for p in prices]), F.array(*[F.struct(F.lit(p[1]).alias("i"), F.lit(p[2]).alias("o"), F.lit(p[3]).alias("label")) for p in prices]))
    u = usage.withColumn("__p", F.coalesce(F.try_element_at(table, F.col("config_ref")), F.try_element_at(table, F.col("model"))))
    u = u.withColumn("input_cost", F.col("prompt_tokens") / 1_000_000 * F.col("__p.i")).withColumn("output_cost", F.col("completion_tokens") / 1_000_000 * F.col("__p.o"))
    return u.withColumn("total_cost", F.col("input_cost") + F.col("output_cost")).withColumn("price_label", F.coalesce("__p.label", F.lit("unknown"))).drop("__p")


def token_report(chunks: DataFrame, *by: str) -> DataFrame:
    """Counts by kind and token statistics: upper median, nearest-rank 95th percentile. chunks: kind, token_count."""
    n = F.count(F.lit(1))
    stats = chunks.groupBy(*by).agg(
        n.alias("chunk_count"), *(F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("standalone", "parent", "child")),
        F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.sum("token_count").alias("total_tokens"), F.expr("percentile_disc(0.95) within group (order by token_count)").cast("long").alias("p95_tokens"),
    )

    keys = list(by)
    order = Window.partitionBy(*keys).orderBy("token_count") if keys else Window.partitionBy(F.lit(0)).orderBy("token_count")
    per_value = chunks.groupBy(*keys, "token_count").agg(n.alias("n"))  # the window runs over distinct counts
    total = per_value.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))))
    median = total.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min("token_count").alias("median_tokens"))
    return stats.join(median, keys) if keys else stats.crossJoin(median)


def cached_runs(records: DataFrame, order: Sequence[str], key: str = "key", measures: Sequence[str] = ("total_tokens",)) -> DataFrame:
    """Records of a run with an exact cache: cache_hit, and for hits the first record's measures instead of their own, saved_ before each.

    A record hits if an earlier one, by order, has its key.
    """
    w = Window.partitionBy(key).orderBy(*order)
    hit = F.row_number().over(w) > 1
    out = records.withColumn("cache_hit", hit)
    for m in measures:
        first = F.first(m).over(w)
        out = out.withColumn(f"saved_{m}", F.when(F.col("cache_hit"), F.coalesce(first, F.lit(0))).otherwise(0)).withColumn(m, first)
    return out
