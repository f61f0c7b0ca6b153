"""Decision lists and small relational operators: routing, recommendations, filters, relative times, text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import col


def any_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def all_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(True)
    for w in words:
        hit = hit & F.contains(text, F.lit(w))
    return hit


def route_question(question: Column | str, general: Sequence[Sequence[str]], structured: Sequence[Sequence[str]], private: Sequence[str]) -> Column:
    """general, structured, retrieval or more_context: the first that fits. A pattern is words that all occur."""
    q = col(question)
    fits = lambda patterns: F.lit(False) if not patterns else sum((all_of(q, p).cast("int") for p in patterns), F.lit(0)) > 0
    return F.when(fits(general), "general").when(fits(structured), "structured").when(any_of(q, private), "retrieval").otherwise("more_context")


def select_path(question: Column | str, tool_words: Sequence[str], knowledge_words: Sequence[str]) -> Column:
    return F.when(any_of(col(question), tool_words), "tool").when(any_of(col(question), knowledge_words), "retrieval").otherwise("plain")


def recommend_solution() -> Column:
    """Seven rules over a scenario's flags, first that fits: behavior_change, changes_often, existing_system, structured_data, few_material, citations, fast_validation, dynamic_routing, precise_keywords."""
    c = F.col
    return (
        F.when(c("behavior_change") & ~c("changes_often"), "fine_tuning")
        .when(c("existing_system") & c("structured_data"), "existing_system")
        .when(c("few_material") & ~c("citations") & ~c("changes_often") & ~c("fast_validation"), "long_context")
        .when(c("fast_validation") & ~c("existing_system") & ~c("dynamic_routing"), "hosted_search")
        .when(c("dynamic_routing"), "agentic_rag")
        .when(c("precise_keywords"), "hybrid_rag")
        .otherwise("two_step_rag")
    )


def eligibility_outcome(eligibility: Column | str) -> Column:
    e = col(eligibility)
    return F.when(e == "current_evidence", F.struct(F.lit("evidence").alias("source_type"), F.lit("mapped").alias("outcome"))).when(e == "historical_context", F.struct(F.lit("history_review").alias("source_type"), F.lit("mapped").alias("outcome"))).otherwise(F.struct(F.lit("other").alias("source_type"), F.lit("excluded").alias("outcome")))


def filtered_books(books: DataFrame, tag: str | None = None, words: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of books by id, with the count of all that fit. books: id, title, author, tags."""
    if tag is not None:
        books = books.where(F.array_contains("tags", tag))
    if words is not None:
        w = F.lit(words.lower())
        books = books.where(F.contains(F.lower("title"), w) | F.contains(F.lower("author"), w))
    total = books.agg(F.count(F.lit(1)).alias("total"))
    return books.orderBy("id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in seconds, minutes, hours, days or months of 30 days; later times are in the future."""
    s = F.unix_seconds(now) - F.unix_seconds(then)
    say = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(s < 0, "in the future").when(s < 60, say(1, "seconds")).when(s < 3600, say(60, "minutes")).when(s < 86400, say(3600, "hours")).when(s < 30 * 86400, say(86400, "days")).otherwise(say(30 * 86400, "months"))


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Events of a run whose number isn't one more than the last. events: run_id, sequence."""
    last = F.lag("sequence").over(Window.partitionBy("run_id").orderBy("sequence"))
    return events.withColumn("last", last).where("last is not null and sequence != last + 1")


def rebuilt_streams(tokens: DataFrame) -> DataFrame:
    """run_id, content, pieces, first and last time of token events. tokens: run_id, sequence, delta, ts."""
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "delta")))  # a run's own tokens
    return tokens.groupBy("run_id").agg(F.array_join(F.transform(ordered, lambda x: x["delta"]), "").alias("content"), F.count(F.lit(1)).alias("pieces"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def is_prime(n: Column) -> Column:
    """By trial division; for small numbers."""
    tried = F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(F.sqrt(n)).cast("int")))
    return (n >= 2) & ((n < 4) | ~F.exists(tried, lambda d: n % d == 0))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def plan_nodes(df: DataFrame) -> list[str]:
    """Names of a query's physical operators, top first."""
    import re

    return re.findall(r"^[ :+\-*()\d]*([A-Z]\w+)", df._jdf.queryExecution().executedPlan().toString(), re.MULTILINE)
