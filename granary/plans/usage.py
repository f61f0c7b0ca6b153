"""Queries over conversations, events and relations: histories, quotas, caches, costs, runs, sets, table changes, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.functions.text import estimate_tokens_mixed
from granary.operators import conversation, evaluation, routing, setops
from granary.plans.retrieval import read
from granary.plans.text import _MIXED, _STRIP
from granary.sources import tables
from granary.streaming import events as streams


def _messages(spark, d):
    return read(spark, d, "conversations")


def _calls(spark, d):
    return read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("user_id").alias("subject"), F.floor("value").cast("long").alias("tokens"))


def history_last_n(spark, d):
    return conversation.recent(_messages(spark, d), 3).select("conv_id", "turn", "role")


def history_buffer(spark, d):
    return conversation.buffered(_messages(spark, d), 3).select("conv_id", "turn", "role")


def history_token_budget(spark, d):
    return conversation.within_budget(_messages(spark, d), 300).select("conv_id", "turn", "role")


def session_tokens(spark, d):
    return conversation.conversation_tokens(_messages(spark, d))


def running_totals(spark, d):
    return conversation.running_totals(_messages(spark, d)).select("conv_id", "turn", "turn_number", "total_tokens")


def daily_quota(spark, d):
    return conversation.daily_quota(_calls(spark, d), 200).select("subject", F.col("day").cast("string").alias("day"), "used", "remaining", "exceeded")


def quota_decisions(spark, d):
    return conversation.quota_decisions(_calls(spark, d), 200).select("event_id", "used_before", "allowed")


def rate_limit(spark, d):
    return conversation.rate_limited(_calls(spark, d), 5).select("event_id", "rejected")


def exact_cache(spark, d):
    return conversation.exact_cache(_calls(spark, d)).select("event_id", "hit")


def ttl_cache_hits(spark, d):
    return conversation.ttl_cache(_calls(spark, d), 7 * 86400).select("event_id", "hit")


def cache_stats(spark, d):
    c = conversation.exact_cache(_calls(spark, d)).withColumn("user", F.substring_index("key", "-", 1))
    e = c.select("user", "hit", F.when(F.col("hit"), F.col("tokens")).otherwise(0).alias("saved_tokens"), F.when(F.col("hit") & (F.col("tokens") > 50), F.col("tokens") * 0.5).alias("saved_cost"), F.when(F.col("hit"), 2.5).otherwise(0.0).alias("saved_latency_ms"))
    return evaluation.cache_summary(e, "user").withColumn("hit_rate", F.round("hit_rate", 6))


def _runs(spark, d):
    e = read(spark, d, "events")
    usage = e.select("event_id", "event_type", "user_id", "value", F.when(F.col("user_id") % 3 == 0, "chat.structured_chat").otherwise("none").alias("config_ref"), F.element_at(F.array(F.lit("gpt-4o"), F.lit("gpt-4o-mini"), F.lit("unknown")), (F.col("event_id") % 3 + 1).cast("int")).alias("model"), F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("long")).alias("prompt_tokens"), F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 2).cast("long")).alias("completion_tokens"))
    return evaluation.priced(usage)


def cost_rollup(spark, d):
    return _runs(spark, d).groupBy("model", "price_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("input_cost"), 8).alias("input_cost"), F.round(F.sum("total_cost"), 8).alias("total_cost"))


def run_summary(spark, d):
    r = _runs(spark, d).select("event_type", (F.col("event_id") % 4 != 0).alias("ok"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("parse_ok"), (F.col("user_id") % 5 == 0).alias("degraded"), F.col("value").alias("latency_ms"), "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.col("total_cost").alias("cost"), (F.col("event_id") % 9 == 0).alias("cache_hit"))
    return evaluation.run_summary(r, "event_type").withColumn("average_latency_ms", F.round("average_latency_ms", 6)).withColumn("estimated_total_cost", F.round("estimated_total_cost", 8))


def error_counts(spark, d):
    return evaluation.error_counts(read(spark, d, "events").select(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("E"), F.col("user_id") % 3)).alias("error_code")))


def event_counts(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def event_json_props(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1))
    return read(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def final_attempts(spark, d):
    a = read(spark, d, "events").select(F.concat_ws("-", "user_id", F.to_date("ts")).alias("request_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("config_ref"), (F.col("value") > 50).alias("ok"))
    return conversation.final_attempts(a)


def _rag_cases(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    refuse, target = F.col("toxic") == 1, F.col("doc_id") % 3 != 0
    c = x.select(F.concat(F.lit("c"), F.col("doc_id") % 4).alias("config_id"), refuse.alias("should_refuse"), target.alias("has_target"), ((F.col("n_chars") % 5) / 4).alias("recall"), ((F.col("n_chars") % 3) / 2).alias("rr"), F.when(F.col("n_chars") % 3 > 0, 1.0).otherwise(0.0).alias("hit"), ((F.col("n_chars") % 7) / 6).alias("point_recall"), F.when(F.col("quality") == 1, 1.0).otherwise(0.5).alias("source_recall"), (F.col("doc_id") % 6 != 0).alias("refusal_correct"), F.when(F.col("n_chars") % 4 > 0, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    c = c.withColumn("citation_support", F.when((F.size("labels") > 0) & (F.col("source_recall") == 1), 1.0).otherwise(0.0))
    return c.withColumn("stage", evaluation.failure_stage(F.col("should_refuse"), F.col("refusal_correct"), F.col("has_target"), F.col("hit"), F.col("source_recall"), F.col("labels"), F.col("point_recall")))


def rag_failure_stages(spark, d):
    return _rag_cases(spark, d).groupBy("config_id", "stage").agg(F.count(F.lit(1)).alias("n"))


def compare_experiments(spark, d):
    c = evaluation.compare_experiments(_rag_cases(spark, d))
    return c.select("config_id", "case_count", F.round("retrieval_recall", 6).alias("retrieval_recall"), F.round("answer_point_recall", 6).alias("answer_point_recall"), F.round("refusal_accuracy", 6).alias("refusal_accuracy"), F.round("pass_rate", 6).alias("pass_rate"), F.round("composite_score", 6).alias("composite_score"))


def set_ops(spark, d):
    a, b = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")), read(spark, d, "supplier").select((F.col("s_nationkey") + 5).alias("k"))
    out = None
    for name, x in setops.set_operations(a, b).items():
        x = x.select(F.lit(name).alias("op"), "k")
        out = x if out is None else out.unionByName(x)
    return out


def word_counter(spark, d):
    return setops.counter(read(spark, d, "part"), F.split("p_type", " ")).select("item", "n")


def _delta(spark, d):
    x = read(spark, d, "documents")
    return x.where("lang = 'de'").selectExpr("doc_id", "concat('new ', lang) as lang", "source").unionByName(x.selectExpr("doc_id + 1000000000 as doc_id", "lang", "source"))


def upsert_merge(spark, d):
    return tables.upsert(read(spark, d, "documents").select("doc_id", "lang", "source"), _delta(spark, d), ["doc_id"], kept=("source",))


def replace_document(spark, d):
    x = read(spark, d, "documents").select("doc_id", "lang", "source")
    return tables.replace_documents(x, x.where("lang = 'fr'").selectExpr("doc_id", "'xx' as lang", "source"), "source")


def delete_cascade(spark, d):
    return tables.delete(read(spark, d, "embeddings").select("vec_id", "label"), read(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id")), ["vec_id"])


def page_window(spark, d):
    return tables.page(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 40, 20)


def order_stats(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


def relative_times(spark, d):
    return read(spark, d, "events").select("event_id", routing.relative_time(F.col("ts").cast("timestamp"), F.lit("2024-01-20 12:00:00").cast("timestamp")).alias("ago"))


def route_questions(spark, d):
    route = routing.route_question(F.lower("text"), [("what", "is"), ("the", "thing")], [("order",), ("tion", "ou")], ["ea", "que"])
    return _messages(spark, d).select("conv_id", "turn", route.alias("route"), routing.select_path(F.lower("text"), ["onon"], ["th", "que"]).alias("path"))


def recommend_solutions(spark, d):
    x = read(spark, d, "labels")
    bit = lambda n: (F.shiftright("doc_id", n) % 2 == 1)
    names = ("behavior_change", "changes_often", "existing_system", "structured_data", "few_material", "citations", "fast_validation", "dynamic_routing", "precise_keywords")
    return x.select("doc_id", *[bit(i).alias(n) for i, n in enumerate(names)]).select("doc_id", routing.recommend_solution().alias("solution"))


def filtered_parts(spark, d):
    books = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.split("p_type", " ").alias("tags"))
    return routing.filtered_books(books, words="A", offset=5, limit=10).select("id", "title", "total")


def rebuilt_streams(spark, d):
    t = _messages(spark, d).select(F.col("conv_id").alias("run_id"), F.col("turn").alias("sequence"), F.col("text").alias("delta"), F.col("turn").alias("ts"))
    return routing.rebuilt_streams(t).select("run_id", F.md5("content").alias("md5"), "pieces", "first_at", "last_at")


def primes(spark, d):
    return read(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).select("p_size", "n", routing.is_prime(F.col("p_size")).alias("prime"), F.round(routing.safe_divide(F.col("n"), F.col("p_size") - 1, -1.0), 6).alias("ratio"))


def stream_tumbling_counts(spark, d):
    s = streams.tumbling_counts(streams.read_events(spark, d))
    out = streams.drained(s, f"tumbling_{uuid.uuid4().hex[:8]}", "complete")
    return out.select(F.col("start").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_distinct_events(spark, d):
    out = streams.drained(streams.distinct_events(streams.read_events(spark, d), ["event_id"]), f"distinct_{uuid.uuid4().hex[:8]}")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_running_quota(spark, d):
    e = streams.read_events(spark, d).select(F.col("user_id").alias("subject"), "ts", F.floor("value").cast("long").alias("tokens"))
    out = streams.drained(streams.running_quota(e, 200), f"quota_{uuid.uuid4().hex[:8]}", "complete")
    return out.withColumn("day", F.col("day").cast("string"))


def rerank_windows_tokens(spark, d):
    return _messages(spark, d).groupBy("role").agg(F.sum(estimate_tokens_mixed("text")).alias("tokens"), F.count(F.lit(1)).alias("n"))


_COST = f"({_MIXED('role')} + {_MIXED('text')} + 4)"
_CALLS = "c as (select event_id, ts, user_id || '-' || event_type as key, user_id as subject, floor(value)::bigint as tokens from events)"
_RUNS = """u as (select *, case when user_id % 3 = 0 then 'chat.structured_chat' else 'none' end as config_ref, ['gpt-4o', 'gpt-4o-mini', 'unknown'][event_id % 3 + 1] as model, case when event_id % 7 <> 0 then floor(value)::bigint end as pt, case when event_id % 7 <> 0 then floor(value / 2)::bigint end as ct from events),
p as (select *, case when config_ref = 'chat.structured_chat' or model = 'gpt-4o' then 2.5::double when model = 'gpt-4o-mini' then 0.15::double end as ip, case when config_ref = 'chat.structured_chat' or model = 'gpt-4o' then 10::double when model = 'gpt-4o-mini' then 0.6::double end as op from u),
r as (select *, pt / 1000000 * ip as input_cost, pt / 1000000 * ip + ct / 1000000 * op as total_cost, case when ip is null then 'unknown' when ip = 2.5 then 'learning_medium' else 'learning_low' end as price_label from p)"""
_CASES = """x as (select * from labels join documents using (doc_id)),
k as (select 'c' || (doc_id % 4) as config_id, toxic = 1 as refuse, doc_id % 3 <> 0 as target, (n_chars % 5) / 4 as recall, (n_chars % 3) / 2 as rr, (n_chars % 3 > 0)::int::double as hit, (n_chars % 7) / 6 as points, case when quality = 1 then 1.0 else 0.5 end::double as sources, doc_id % 6 <> 0 as correct, n_chars % 4 > 0 as labelled from x),
s as (select *, (labelled and sources = 1)::int::double as cited, case when not correct then 'refusal_boundary' when refuse then 'pass' when target and hit = 0 then 'retrieval' when sources < 1 then 'citation_alignment' when not labelled then 'citation_format' when points < 1 then 'answer_quality' else 'pass' end as stage from k)"""

QUERIES = {f.__name__: f for f in (history_last_n, history_buffer, history_token_budget, session_tokens, running_totals, daily_quota, quota_decisions, rate_limit, exact_cache, ttl_cache_hits, cache_stats, cost_rollup, run_summary, error_counts, event_counts, event_json_props, final_attempts, rag_failure_stages, compare_experiments, set_ops, word_counter, upsert_merge, replace_document, delete_cascade, page_window, order_stats, relative_times, route_questions, recommend_solutions, filtered_parts, rebuilt_streams, primes, stream_tumbling_counts, stream_distinct_events, stream_running_quota)}
QUERIES["role_tokens"] = rerank_windows_tokens

SQL = {
    "history_last_n": "select conv_id, turn, role from conversations qualify role = 'system' or row_number() over (partition by conv_id, role = 'system' order by turn desc) <= 3",
    "history_buffer": f"""with m as (select *, role = 'system' as s from (select conv_id, turn, role, {_STRIP('text')} as text from conversations) where text <> ''),
      b as (select *, row_number() over (partition by conv_id, s order by turn desc) as back, row_number() over (partition by conv_id, s order by turn) as fwd, count(*) over (partition by conv_id) as n, max(s::int) over (partition by conv_id) as sys from m)
      select conv_id, turn, role from b where n <= 3 or case when s then fwd = 1 else back <= 3 - sys end""",
    "history_token_budget": f"""with m as (select conv_id, turn, role, role = 'system' as s, {_COST} as cost from conversations),
      b as (select *, coalesce(sum(cost) filter (s) over (partition by conv_id), 0) as sys, sum(cost) over (partition by conv_id, s order by turn desc) as running from m) select conv_id, turn, role from b where s or running + sys + 2 <= 300""",
    "session_tokens": f"select conv_id, sum({_COST}) + 2 as tokens from conversations group by conv_id",
    "running_totals": f"select conv_id, turn, row_number() over (partition by conv_id order by turn) as turn_number, sum({_COST}) over (partition by conv_id order by turn) as total_tokens from conversations",
    "daily_quota": f"with {_CALLS} select subject, ts::date::varchar as day, sum(tokens) as used, greatest(0, 200 - sum(tokens)) as remaining, sum(tokens) >= 200 as exceeded from c group by subject, ts::date",
    "quota_decisions": f"with {_CALLS}, b as (select event_id, tokens, coalesce(sum(tokens) over (partition by subject, ts::date order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as used_before from c) select event_id, used_before, used_before + tokens <= 200 as allowed from b",
    "rate_limit": f"with {_CALLS} select event_id, row_number() over (partition by key order by ts, event_id) > 5 as rejected from c",
    "exact_cache": f"with {_CALLS} select event_id, row_number() over (partition by key order by ts, event_id) > 1 as hit from c",
    "ttl_cache_hits": f"""with recursive {_CALLS}, f as (select key, min((ts, event_id)) as fill from c group by key union all select f.key, min((c.ts, c.event_id)) from f join c on c.key = f.key and c.ts >= f.fill[1] + interval 7 day group by f.key, f.fill)
      select event_id, event_id not in (select fill[2] from f) as hit from c""",
    "cache_stats": f"""with {_CALLS}, h as (select *, subject::varchar as u, row_number() over (partition by key order by ts, event_id) > 1 as hit from c)
      select u as user, count(*) as total, count(*) filter (hit) as hit_count, count(*) filter (not hit) as miss_count, coalesce(sum(tokens) filter (hit), 0) as saved_tokens, sum(tokens * 0.5::double) filter (hit and tokens > 50) as saved_estimated_cost, sum(case when hit then 2.5::double else 0 end) as saved_latency_ms, round(count(*) filter (hit) / count(*), 6) as hit_rate from h group by u""",
    "cost_rollup": f"with {_RUNS} select model, price_label, count(*) as n, round(sum(input_cost), 8) as input_cost, round(sum(total_cost), 8) as total_cost from r group by all",
    "run_summary": f"""with {_RUNS} select event_type, count(*) as total, count(*) filter (event_id % 4 <> 0) as success_count, count(*) filter (event_id % 4 = 0) as failed_count, count(*) filter (event_id % 2 = 0 and event_id % 3 = 0) as parse_success_count, count(*) filter (user_id % 5 = 0) as degraded_count,
      round(avg(value), 6) as average_latency_ms, max(value) as max_latency_ms, sum(coalesce(pt, 0)) as prompt_tokens, sum(coalesce(ct, 0)) as completion_tokens, sum(coalesce(pt + ct, 0)) as total_tokens, round(sum(total_cost), 8) as estimated_total_cost, count(*) filter (event_id % 9 = 0) as cache_hit_count from r group by event_type""",
    "error_counts": "select 'E' || (user_id % 3) as error_code, count(*) as n from events where event_id % 4 = 0 group by 1",
    "event_counts": "select event_type, count(*) as n, round(avg(value), 6) as mean from events group by event_type",
    "event_json_props": "select coalesce(json_extract_string(props, '$.k')::bigint, -1) as k, count(*) as n from events group by 1",
    "final_attempts": "select user_id || '-' || ts::date as request_id, count(*) as attempts, max_by(event_type, event_id) as config_ref, max_by(value > 50, event_id) as ok from events group by 1",
    "rag_failure_stages": f"with {_CASES} select config_id, stage, count(*) as n from s group by all",
    "compare_experiments": f"""with {_CASES}, m as (select config_id, count(*) as case_count, coalesce(avg(recall) filter (target), 0) as rc, coalesce(avg(rr) filter (target), 0) as mr, coalesce(avg(points) filter (not refuse), 0) as ap, coalesce(avg(sources) filter (not refuse), 0) as sr, coalesce(avg(cited) filter (not refuse), 0) as cs, coalesce(avg(correct::int) filter (refuse), 0) as ra, avg((stage = 'pass')::int) as pr from s group by config_id)
      select config_id, case_count, round(rc, 6) as retrieval_recall, round(ap, 6) as answer_point_recall, round(ra, 6) as refusal_accuracy, round(pr, 6) as pass_rate, round(0.2::double * rc + 0.1::double * mr + 0.2::double * ap + 0.15::double * sr + 0.15::double * cs + 0.1::double * ra + 0.1::double * pr, 6) as composite_score from m""",
    "set_ops": """with a as (select c_nationkey as k from customer), b as (select s_nationkey + 5 as k from supplier)
      select 'union' as op, k from (select k from a union select k from b) union all select 'intersection', k from (select k from a intersect select k from b) union all select 'difference', k from (select k from a except select k from b)
      union all select 'symmetric', k from ((select k from a except select k from b) union (select k from b except select k from a))""",
    "word_counter": "select item, count(*) as n from (select unnest(string_split(p_type, ' ')) as item from part) group by item",
    "upsert_merge": "select doc_id, case when lang = 'de' then 'new de' else lang end as lang, source from documents union all select doc_id + 1000000000, lang, source from documents",
    "replace_document": "select doc_id, lang, source from documents where source not in (select source from documents where lang = 'fr') union all select doc_id, 'xx', source from documents where lang = 'fr'",
    "delete_cascade": "select vec_id, label from embeddings where vec_id not in (select doc_id from labels where quality = 0)",
    "page_window": "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey limit 20 offset 40",
    "order_stats": "select o_orderpriority, count(*) as n, round(avg(o_totalprice), 2) as mean, min(o_totalprice) as least, max(o_totalprice) as most, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as statuses from orders group by o_orderpriority",
    "relative_times": """with s as (select event_id, epoch(timestamp '2024-01-20 12:00:00')::bigint - floor(epoch(ts))::bigint as s from events)
      select event_id, case when s < 0 then 'in the future' when s < 60 then s || ' seconds ago' when s < 3600 then s // 60 || ' minutes ago' when s < 86400 then s // 3600 || ' hours ago' when s < 2592000 then s // 86400 || ' days ago' else s // 2592000 || ' months ago' end as ago from s""",
    "route_questions": """with t as (select conv_id, turn, lower(text) as t from conversations) select conv_id, turn, case when (contains(t, 'what') and contains(t, 'is')) or (contains(t, 'the') and contains(t, 'thing')) then 'general' when contains(t, 'order') or (contains(t, 'tion') and contains(t, 'ou')) then 'structured' when contains(t, 'ea') or contains(t, 'que') then 'retrieval' else 'more_context' end as route,
      case when contains(t, 'onon') then 'tool' when contains(t, 'th') or contains(t, 'que') then 'retrieval' else 'plain' end as path from t""",
    "recommend_solutions": """with b as (select doc_id, list_transform(range(0, 9), lambda i: (doc_id >> i) % 2 = 1) as f from labels)
      select doc_id, case when f[1] and not f[2] then 'fine_tuning' when f[3] and f[4] then 'existing_system' when f[5] and not f[6] and not f[2] and not f[7] then 'long_context' when f[7] and not f[3] and not f[8] then 'hosted_search' when f[8] then 'agentic_rag' when f[9] then 'hybrid_rag' else 'two_step_rag' end as solution from b""",
    "filtered_parts": "with p as (select p_partkey as id, p_name as title from part where contains(lower(p_name), 'a') or contains(lower(p_brand), 'a')) select id, title, (select count(*) from p) as total from p order by id limit 10 offset 5",
    "rebuilt_streams": "select conv_id as run_id, md5(string_agg(text, '' order by turn)) as md5, count(*) as pieces, min(turn) as first_at, max(turn) as last_at from conversations group by conv_id",
    "primes": "with g as (select p_size, count(*) as n from part group by p_size) select p_size, n, p_size >= 2 and len(list_filter(range(2, p_size), lambda d: p_size % d = 0)) = 0 as prime, round(case when p_size = 1 then -1 else n / (p_size - 1) end, 6) as ratio from g",
    "stream_tumbling_counts": "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "stream_distinct_events": "select event_type, count(distinct event_id) as n from events group by event_type",
    "stream_running_quota": "select user_id as subject, ts::date::varchar as day, sum(floor(value)::bigint) as used, sum(floor(value)::bigint) >= 200 as exceeded from events group by user_id, ts::date",
    "role_tokens": f"select role, sum({_MIXED('text')}) as tokens, count(*) as n from conversations group by role",
}
