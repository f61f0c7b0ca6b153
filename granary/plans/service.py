"""Queries of services and answer streams over the events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from granary.operators import service
from granary.plans.retrieval import read

LIMIT, TTL = 180, 4 * 86_400
SILENCE = timedelta(days=2)


def _calls(spark, d):
    e, n = read(spark, d, "events"), F.col("event_id")
    return e.select(
        (F.col("user_id") % 100).alias("service"), n.alias("call_id"), F.col("event_type").alias("subject"), "ts", F.floor(F.col("value") / 15).cast("string").alias("cache_key"), (F.floor("value") + 20).alias("estimated"),
        F.when(n % 11 != 0, F.floor("value") + n % 7).alias("tokens"), (n % 9 != 0).alias("ok"), (n % 13 == 0).alias("blocked"), (n % 5 != 0).alias("use_cache"),
    )


def service_order(spark, d):
    """Calls of a hundred services: what is guarded, over its quota, cached, failed, and billed."""
    return service.served(_calls(spark, d), LIMIT, TTL)


def _pieces(spark, d):
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "end").when(F.col("event_id") % 17 == 0, "error").otherwise("token")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), "ts", kind.alias("type"), F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("delta"), F.when(kind == "error", F.lit("provider_error")).alias("code"))


def streamed_answers(spark, d):
    """A user's events as an answer stream: each has an end, silent ones by a timeout."""
    s = service.streamed(_pieces(spark, d), SILENCE)
    return s.select("run_id", "sequence", "type", "code", "delta", F.unix_micros("ts").alias("micros"), "first_token_ms", "elapsed_ms", "chunk_count", F.md5("content").alias("md5"))


QUERIES = {f.__name__: f for f in (service_order, streamed_answers)}

SQL = {
    "service_order": f"""with recursive c as (select (user_id % 100)::varchar as service, event_id as call_id, event_type as subject, epoch_us(ts) as t, floor(value / 15)::bigint::varchar as k, floor(value)::bigint + 20 as est,
        case when event_id % 11 <> 0 then floor(value)::bigint + event_id % 7 end as tokens, event_id % 9 <> 0 as ok, event_id % 13 = 0 as blocked, event_id % 5 <> 0 as use_cache from events),
      n as (select *, subject || ':' || (t // 86400000000) as sd, row_number() over (partition by service order by t, call_id) as i from c),
      s as (select service, 0 as i, null::bigint as call_id, map([]::varchar[], []::bigint[]) as cache, map([]::varchar[], []::bigint[]) as quota, null::varchar as status, 0::bigint as billed, null::bigint as used from (select distinct service from c)
        union all
        select service, i, call_id, case when status = 'called' and use_cache then map_concat(cache, map([k], [t + {TTL}000000])) else cache end, case when billed > 0 then map_concat(quota, map([sd], [so_far + billed])) else quota end, status, billed, case when status <> 'blocked' then so_far + billed end
        from (select *, case when status = 'called' then greatest(coalesce(tokens, 0), 0) else 0 end as billed from
          (select *, case when blocked then 'blocked' when so_far + est > {LIMIT} then 'quota_exceeded' when use_cache and coalesce(cache[k], 0) > t then 'cached' when not ok then 'failed' else 'called' end as status from
            (select n.*, s.cache, s.quota, coalesce(s.quota[n.sd], 0) as so_far from s join n on n.service = s.service and n.i = s.i + 1))))
      select service, call_id, status, billed::bigint as billed, used, case when used is not null then greatest({LIMIT} - used, 0) end as remaining from s where i > 0""",
    "streamed_answers": f"""with p as (select user_id as run_id, event_id as sequence, epoch_us(ts) as t, case when event_type = 'purchase' then 'end' when event_id % 17 = 0 then 'error' else 'token' end as type, coalesce(case when event_id % 4 <> 0 then props end, '') as delta from events),
      f as (select *, coalesce(t - lag(t) over w > {int(SILENCE.total_seconds())}000000 or lag(type) over w in ('end', 'error'), false) as over from p window w as (partition by run_id order by t, sequence)),
      k as (select * from (select *, bool_or(over) over (partition by run_id order by t, sequence) as gone from f) where not gone),
      r as (select run_id, min(t) as began, min(t) filter (type = 'token' and delta <> '') as first, count(*) filter (type = 'token' and delta <> '') as chunks, coalesce(string_agg(delta, '' order by t, sequence) filter (type = 'token' and delta <> ''), '') as content, max({{'t': t, 's': sequence, 'type': type}}) as last from k group by run_id),
      e as (select *, case when last.type in ('end', 'error') then last.t else last.t + {int(SILENCE.total_seconds())}000000 end as stopped, case last.type when 'end' then null when 'error' then 'provider_error' else 'stream_timeout' end as code from r),
      x as (select run_id, 0 as stage, began as t, 0 as n, 'message_start' as type, null as code, null as delta, null as f, null as el, null as c, null as content from e
        union all select run_id, 1, t, sequence, 'token', null, delta, null, null, null, null from k where type = 'token' and delta <> ''
        union all select run_id, 2, stopped, 0, case when code is null then 'message_done' else 'error' end, code, null, (first - began) / 1000, (stopped - began) / 1000, chunks, content from e
        union all select run_id, 3, stopped, 0, 'done', null, null, (first - began) / 1000, (stopped - began) / 1000, chunks, content from e)
      select run_id, row_number() over (partition by run_id order by stage, t, n) as sequence, type, code, delta, t as micros, f as first_token_ms, el as elapsed_ms, c as chunk_count, md5(content) as md5 from x""",
}
