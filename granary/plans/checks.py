"""Queries that check routes, answers and runs before they are used."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import vector as V
from granary.operators import context, evaluation, retrieval
from granary.plans.retrieval import read
from granary.streaming import events as streams


def _candidates(spark, d):
    """Events as candidates: a user is a chunk that event types route to, ranked by day."""
    e = read(spark, d, "events")
    return e.select(F.col("event_type").alias("route_name"), (F.col("user_id") % 20).alias("query_id"), F.col("user_id").alias("chunk_id"), F.floor(F.col("value") / 40).alias("document_id"), F.dayofmonth(F.col("ts").cast("timestamp")).alias("rank"))


def route_conflicts(spark, d):
    return retrieval.route_conflicts(_candidates(spark, d), ["document_id", "query_id"])


def rank_faults(spark, d):
    c = _candidates(spark, d).groupBy("query_id", "route_name", "chunk_id").agg(F.min("rank").alias("rank"))
    return retrieval.rank_faults(c)


def trusted_answers(spark, d):
    c = read(spark, d, "conversations")
    risk = F.concat(F.lit('{"title": "t", "category": "api", "level": "'), F.when(F.col("turn") % 4 == 3, "none").otherwise("low"), F.lit('", "rationale": "r", "citations": [{"source_id": "src'), F.length("text") % 30, F.lit('", "excerpt": "x"}]}'))
    answers = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), F.when(F.col("role") == "system", F.col("text")).otherwise(risk).alias("content"))
    allowed = read(spark, d, "documents").select(F.col("source").alias("source_id")).where("source_id != 'src7'")
    return context.trusted_answers(answers, allowed).select("request_id", "status", "error_stage", "risks", "citations", F.array_join("unknown", ",").alias("unknown"))


def cached_runs(spark, d):
    r = read(spark, d, "events").select("event_id", "ts", F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("key"), F.floor("value").cast("long").alias("total_tokens"))
    return evaluation.cached_runs(r, ["ts", "event_id"]).select("event_id", "cache_hit", "total_tokens", "saved_total_tokens")


#: Model configurations of the catalogue: name, role, whether it streams.
MODELS = (("e0", "chat", True), ("e1", "chat", False), ("e2", "embedding", None), ("e3", "chat", None))


def guarded_streams(spark, d):
    requests = read(spark, d, "events").select(F.col("event_id").alias("run_id"), F.concat(F.lit("e"), F.col("user_id") % 5).alias("config_ref"))
    return streams.stream_guard(requests, spark.createDataFrame(MODELS, "config_ref string, role string, streaming boolean"))


def mock_semantic_vectors(spark, d):
    return read(spark, d, "documents").select("doc_id", F.transform(V.mock_semantic_vector("text"), lambda x: F.round(x, 6)).alias("v"))


_CANDIDATES = "c as (select event_type as route_name, user_id % 20 as query_id, user_id as chunk_id, floor(value / 40) as document_id, day(ts) as rank from events)"
_HITS = ", ".join("(" + " + ".join(f"contains(t, '{w}')::double" for w in words) + ")" for _, words in V.SEMANTIC_CONCEPTS)

QUERIES = {f.__name__: f for f in (route_conflicts, rank_faults, trusted_answers, cached_runs, guarded_streams, mock_semantic_vectors)}

SQL = {
    "route_conflicts": f"with {_CANDIDATES} select chunk_id, count(distinct (document_id, query_id)) as variants from c group by chunk_id having variants > 1",
    "rank_faults": f"""with {_CANDIDATES}, g as (select query_id, route_name, chunk_id, min(rank) as rank from c group by all),
      r as (select query_id, route_name, list(rank order by rank) as ranks from g group by all) select query_id, route_name, 'ranks_not_contiguous' as reason from r where ranks <> range(1, len(ranks) + 1)""",
    "trusted_answers": """with a as (select conv_id || '-' || turn as request_id, role = 'system' as bad_json, turn % 4 = 3 as bad_level, 'src' || (length(text) % 30) as s, text from conversations),
      k as (select *, bad_json or bad_level as invalid, s <> 'src7' and s in (select source from documents) as known from a)
      select request_id, case when invalid then 'structured_invalid' when known then 'succeeded' else 'unknown_citation' end as status, case when bad_json and trim(text) = '' then 'empty' when bad_json then 'json' when bad_level then 'schema' end as error_stage,
      (not invalid)::int as risks, (not invalid)::int as citations, case when invalid or known then '' else s end as unknown from k""",
    "cached_runs": """select event_id, row_number() over w > 1 as cache_hit, first_value(floor(value)::bigint) over w as total_tokens, case when row_number() over w > 1 then first_value(floor(value)::bigint) over w else 0 end as saved_total_tokens
      from events window w as (partition by user_id, event_type order by ts, event_id)""",
    "guarded_streams": """with r as (select event_id as run_id, 'e' || (user_id % 5) as config_ref from events), m as (select run_id, config_ref, case config_ref when 'e1' then 'e1 can''t stream' when 'e2' then 'e2 is for embedding, not for chat' end as message from r where config_ref in ('e1', 'e2'))
      select run_id, 1 as sequence, 'error' as type, 'capability_mismatch' as code, message, config_ref from m union all select run_id, 2, 'done', null, null, config_ref from m""",
    "mock_semantic_vectors": f"""with n as (select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t from documents), v as (select doc_id, [{_HITS}]::double[] as v from n)
      select doc_id, list_transform(v, lambda x: round(case when list_sum(v) = 0 then 0 else x / sqrt(list_sum(list_transform(v, lambda y: y * y))) end, 6)) as v from v""",
}
