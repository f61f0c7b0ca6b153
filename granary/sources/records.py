"""JSON and configuration sources: golden sets, experiments, evaluation cases, model and prompt registries, exports."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "case_id string, question string, expected_answer string, expected_answer_points array<string>, expected_sources array<string>, retrieval_expected_chunk_ids array<string>, should_refuse boolean, tags array<string>, filename_filter string, notes string"
EXPERIMENT = "config_id string, label string, strategy string, top_k int, candidate_k int, score_threshold double, mmr_lambda double, hybrid_alpha double, filename_filter string, rerank boolean, fetch_k int, rerank_top_n int, min_context_score double, max_chunks int, max_chars_per_chunk int, prompt_variant string, notes string"
#: Fixed defaults of experiments.
EXPERIMENT_DEFAULTS = {"strategy": "similarity", "top_k": 3, "candidate_k": 4, "score_threshold": 0.80, "mmr_lambda": 0.35, "hybrid_alpha": 0.5, "rerank": False, "min_context_score": 0.35, "max_chunks": 3, "max_chars_per_chunk": 90, "prompt_variant": "baseline"}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON list of objects. Anything else fails when it is read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    df = read_json(spark, path, GOLDEN)
    lists = ("expected_answer_points", "expected_sources", "retrieval_expected_chunk_ids", "tags")
    df = df.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    return df.withColumns({"expected_answer": F.coalesce("expected_answer", F.lit("")), "should_refuse": F.coalesce("should_refuse", F.lit(False)), "filename_filter": F.nullif("filename_filter", F.lit(""))})


def golden_summary(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if(F.size("retrieval_expected_chunk_ids") > 0).alias("retrieval_cases"), F.count_if(~F.col("should_refuse")).alias("answerable_cases"), F.count_if("should_refuse").alias("refusal_cases"), F.count_if(F.size("expected_sources") > 0).alias("cases_with_expected_sources"))


def experiments(spark: SparkSession, path: str) -> DataFrame:
    df = read_json(spark, path, EXPERIMENT)
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in EXPERIMENT_DEFAULTS.items()})


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, question, expected_chunk_ids, filename_filter; a case without expected chunks is an error."""
    df = read_json(spark, path, "case_id string, question string, expected_chunk_ids array<string>, filename_filter string")
    none = F.raise_error(F.concat(F.lit("no expected chunks: "), "case_id")).cast("array<string>")
    return df.withColumn("expected_chunk_ids", F.when(F.size("expected_chunk_ids") > 0, F.col("expected_chunk_ids")).otherwise(none))


def bad_case_checks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, strategy, status (pass, fail, info), failures.

    results: case_id, strategy, chunk_id, rank, filename; expected: case_id, strategy, top_chunk_id, count, empty,
    filename, must_include (array), max_redundancy and redundancy, all but the keys nullable.
    """
    got = results.groupBy("case_id", "strategy").agg(F.min_by("chunk_id", "rank").alias("top"), F.count(F.lit(1)).alias("n"), F.collect_set("chunk_id").alias("ids"), F.collect_set("filename").alias("files"))
    x = expected.join(got, ["case_id", "strategy"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    tests = {
        "top_chunk_id": F.col("top_chunk_id").isNotNull() & (F.coalesce("top", F.lit("none")) != F.col("top_chunk_id")),
        "count": F.col("count").isNotNull() & (F.col("n") != F.col("count")),
        "empty": F.col("empty").isNotNull() & (F.col("empty") != (F.col("n") == 0)),
        "filename": F.col("filename").isNotNull() & ~F.coalesce(F.col("files") == F.array("filename"), F.lit(False)),
        "must_include": F.col("must_include").isNotNull() & (F.size(F.array_except("must_include", "ids")) > 0),
        "max_redundancy": F.col("max_redundancy").isNotNull() & (F.coalesce("redundancy", F.lit(0.0)) > F.col("max_redundancy")),
    }
    failures = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    any_test = F.greatest(*[F.col(c).isNotNull() for c in tests])
    return x.withColumn("failures", failures).select("case_id", "strategy", F.when(~any_test, "info").when(F.size("failures") > 0, "fail").otherwise("pass").alias("status"), "failures")


def resolved(value: object, environment: Mapping[str, str] | None = None) -> object:
    """Configuration with ${NAME} and ${NAME:-default} filled in."""
    env = os.environ if environment is None else environment
    if isinstance(value, str):
        return re.sub(r"\$\{([^}:]+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), value)
    if isinstance(value, dict):
        return {k: resolved(v, env) for k, v in value.items()}
    return [resolved(v, env) for v in value] if isinstance(value, list) else value


def model_registry(sections: dict, environment: Mapping[str, str] | None = None) -> dict[str, dict]:
    """Models by section.name. sections: what a configuration file holds."""
    out = {}
    for section, entries in resolved(sections, environment).items():
        for name, entry in (entries if isinstance(entries, dict) else {}).items():
            if isinstance(entry, dict):
                out[f"{section}.{name}"] = {"role": section, "default_params": {}, **entry, "base_url": entry.get("base_url") or None}
    return out


def prompt(templates: list[dict], prompt_id: str, version: str | None = None) -> dict:
    """A prompt template by id: this version, or the greatest. Versions compare as strings, so 9.0.0 is after 10.0.0."""
    plain = lambda v: str(v).removeprefix("v")
    found = [t for t in templates if t["prompt_id"] == prompt_id and (version is None or plain(t["version"]) == plain(version))]
    if not found:
        raise KeyError(f"no prompt {prompt_id} {version or ''}")
    return max(found, key=lambda t: plain(t["version"]))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)
