"""Services and answer streams: the batch forms, and streams that agree with them."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.operators import service
from granary.streaming import service as streams

START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.STORE)
    yield spark
    spark.conf.set(key, before)


def fed(spark, tmp_path, batches, schema, make):
    """All that a stream gives, each batch a file of its own. Returns its rows, and how many rows of state are left."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    files = sorted(tmp_path.glob("in/*/*.parquet"), key=lambda p: int(p.parent.name))
    (tmp_path / "seen").mkdir()
    for i, f in enumerate(files):
        target = tmp_path / f"seen/{i:03}.parquet"
        target.write_bytes(f.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "seen")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


CALLS = "service string, call_id long, subject string, ts timestamp, cache_key string, estimated long, tokens long, ok boolean, blocked boolean, use_cache boolean"


def some_calls(n, seed=1, services="abc"):
    r = random.Random(seed)
    at, out = START, []
    for i in range(n):
        at += timedelta(minutes=r.choice([0, 1, 30, 200]))
        out.append((r.choice(services), i, r.choice("xy"), at, r.choice("klmno"), r.randint(1, 60), r.choice([None, -5, *range(50)]), r.random() < 0.8, r.random() < 0.1, r.random() < 0.9))
    return out


def plain_service(calls, limit, ttl):
    cache, quota, out = {}, {}, {}
    for s, i, subject, at, key, est, tokens, ok, blocked, use in sorted(calls, key=lambda c: (c[0], c[3], c[1])):
        day = (s, subject, at.date())
        used, billed = quota.get(day, 0), 0
        if blocked:
            status, used = "blocked", None
        elif used + est > limit:
            status = "quota_exceeded"
        elif use and (s, key) in cache and at < cache[s, key]:
            status = "cached"
        elif not ok:
            status = "failed"
        else:
            status, billed = "called", max(0, tokens or 0)
            used = quota[day] = used + billed
            if use:
                cache[s, key] = at + timedelta(seconds=ttl)
        out[i] = (s, status, billed, used, None if used is None else max(0, limit - used))
    return out


def as_rows(rows):
    return {r["call_id"]: (r["service"], r["status"], r["billed"], r["used"], r["remaining"]) for r in rows}


def test_service_order(spark):
    calls = some_calls(600)
    got = as_rows(service.served(spark.createDataFrame(calls, CALLS).repartition(5), 120, 5000).collect())
    want = plain_service(calls, 120, 5000)
    assert got == want and {x[1] for x in want.values()} == {"blocked", "quota_exceeded", "cached", "failed", "called"}


def test_service_stream_agrees(rocks, tmp_path):
    calls = some_calls(200, 2)
    end = (calls[-1][3] + timedelta(days=9),)
    after = [("z", 1000 + i, "x", end[0] + timedelta(days=3 * i), "k", 1, 1, True, False, True) for i in range(2)]
    batches = [calls[:70], calls[70:130], calls[130:], after[:1], after[1:]]
    rows, left = fed(rocks, tmp_path, batches, CALLS, lambda s: streams.served(s, 120, 5000))
    got = as_rows(rows)
    assert {i: got[i] for i in range(200)} == plain_service(calls, 120, 5000)
    assert left <= 4  # the first three services are forgotten; z has its answers and day


PIECES = "run_id long, sequence long, ts timestamp, type string, delta string, code string"


def some_runs(n=40, seed=3):
    r = random.Random(seed)
    out = []
    for run in range(n):
        at = START + timedelta(seconds=r.randint(0, 300))
        for k in range(r.randint(1, 12)):
            kind = r.choices(["token", "end", "error"], [12, 1, 1])[0]
            out.append((run, k, at, kind, r.choice(["a", "bc", "", None]) if kind == "token" else None, "provider_error" if kind == "error" else None))
            at += timedelta(seconds=r.choice([0, 1, 3, 10, 11, 25]))
    return out


def plain_stream(pieces, silence):
    out = []
    for run in sorted({p[0] for p in pieces}):
        own = sorted((p for p in pieces if p[0] == run), key=lambda p: (p[2], p[1]))
        began = last = own[0][2]
        events, first, content, code, at = [("message_start", None, None, began)], None, "", "stream_timeout", None
        chunks = 0
        for _, _, ts, kind, delta, error in own:
            if ts - last > silence:
                break
            last = ts
            if kind == "token" and delta:
                chunks += 1
                first = first or ts
                content += delta
                events.append(("token", None, delta, ts))
            elif kind != "token":
                code, at = error, ts
                break
        at = at or last + silence
        ms = lambda t: None if t is None else (t - began) / timedelta(milliseconds=1)
        out += [(run, n, *e, None, None, None, None) for n, e in enumerate(events, 1)]
        out += [(run, len(events) + 1, "error" if code else "message_done", code, None, at, ms(first), ms(at), chunks, content), (run, len(events) + 2, "done", None, None, at, ms(first), ms(at), chunks, content)]
    return out


def event_rows(rows):
    return sorted((tuple(r[c] if c != "ts" else r[c].replace(tzinfo=UTC) for c in (x.split()[0] for x in service.STREAMED.split(", "))) for r in rows), key=lambda x: x[:2])


def test_every_run_ends(spark):
    pieces = some_runs()
    silence = timedelta(seconds=10)
    df = spark.createDataFrame(pieces, PIECES).repartition(4)
    want = plain_stream(pieces, silence)
    assert event_rows(service.streamed(df, silence).collect()) == want
    assert {x[3] for x in want} == {None, "stream_timeout", "provider_error"}
    early = service.streamed(df, silence, as_of=START + timedelta(seconds=150))
    ended = {r["run_id"] for r in early.where("type = 'done'").collect()}
    assert 0 < len(ended) < 40 and early.select("run_id").distinct().count() == 40


def test_stream_ends_runs_and_forgets_them(rocks, tmp_path):
    """Pieces of a run come in order over several batches; one run never ends by itself, and late pieces don't open it again."""
    silence = timedelta(seconds=10)
    pieces = sorted(some_runs(12, 4), key=lambda p: (p[2], p[0], p[1]))
    endless = [(99, 0, START, "token", "a", None), (99, 1, START + timedelta(seconds=5), "token", "b", None)]
    third = len(pieces) // 3
    clock = [(1000 + i, 0, START + timedelta(hours=1 + 3 * i), "end", None, None) for i in range(3)]
    late = [(99, 2, START + timedelta(seconds=60), "token", "late", None)]
    batches = [endless + pieces[:third], pieces[third : 2 * third], pieces[2 * third :], clock[:1], late, clock[1:2], clock[2:]]
    rows, left = fed(rocks, tmp_path, batches, PIECES, lambda s: streams.streamed(s, silence, late="0 seconds"))
    got = [x for x in event_rows(rows) if x[0] < 1000]
    assert got == plain_stream(pieces + endless, silence)
    assert [x[2:5] for x in got if x[0] == 99] == [("message_start", None, None), ("token", None, "a"), ("token", None, "b"), ("error", "stream_timeout", None), ("done", None, None)]
    assert left <= 2  # marks of the last clocks
