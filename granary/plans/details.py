"""Queries over small parts: prompts, labels, structured output, ids, arrays, tables, cases, retries and the engines."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from granary.functions import identity, prompting, structured, values
from granary.functions import text as T
from granary.functions.vector import CONCEPTS
from granary.operators import chunking, evaluation, hybrid, providers, routing, setops
from granary.plans.retrieval import _BM25, read
from granary.plans.text import _LINES, _STRIP, _W
from granary.sources import records, tables
from granary.sources.tables import spread

PROMPTS = ("你是助手。请根据材料回答", "任务：总结。输出格式：JSON", "背景：无。要求：控制在十句", "不要编造。示例：甲", "plain")
QUESTION = "Where does the source id of a refund vector come from?"
LABELS = ("the", "an", "of")


def _chosen(options, key):
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.col(key) % len(options) + 1).cast("int"))


def _turns(spark, d):
    return read(spark, d, "conversations")


def prompt_audits(spark, d):
    p = _turns(spark, d).select("conv_id", "turn", prompting.audit_prompt(F.concat(_chosen(PROMPTS, "turn"), F.lit(" "), "text")).alias("a"))
    return p.select("conv_id", "turn", "a.*")


def context_relevance(spark, d):
    return read(spark, d, "documents").select("doc_id", prompting.relevance(F.lit(QUESTION), "text").alias("relevance"))


def shown_contexts(spark, d):
    line = prompting.shown_context(F.lit("S1"), F.col("source"), F.col("doc_id") % 7, F.col("n_chars") / 8, F.lit(0.5), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(line).alias("md5"))


def numbered_sources(spark, d):
    of = F.array(F.struct(F.col("source"), F.col("lang").alias("title"), F.col("text").alias("content")))
    return read(spark, d, "documents").select("doc_id", F.md5(prompting.numbered_sources(F.when(F.col("doc_id") % 2 == 0, of).otherwise(F.slice(of, 1, 0)))).alias("md5"))


def _labelled():
    n = lambda by: (F.length("text") % by + 1).cast("string")
    return F.concat(F.lit("so [S"), n(3), F.lit("] and [S"), n(2), F.lit("] or [S"), n(3), F.lit("], not [x1]"))


def answer_source_labels(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.array_join(T.source_labels(_labelled()), ",").alias("labels"))


def used_sources(spark, d):
    results = F.array(F.struct(F.col("role").alias("source")), F.struct(F.lit("other").alias("source")))
    used = prompting.used_results(T.source_labels(_labelled()), results)
    return _turns(spark, d).select("conv_id", "turn", F.array_join(F.transform(used, lambda r: r["source"]), ",").alias("used"))


def picked_labels(spark, d):
    return _turns(spark, d).select("conv_id", "turn", T.pick_label("text", LABELS).alias("label"))


def lexical_overlaps(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.round(T.lexical_overlap(F.lit("The one that erth and enst, this"), "text"), 6).alias("overlap"))


def template_audits(spark, d):
    template = F.concat(F.lit("{{ role }} {{text}} {{ "), "role", F.lit("_name }}"))
    a = _turns(spark, d).select("conv_id", "turn", T.template_audit(template, F.array(F.lit("text"), F.lit("unused"))).alias("a"))
    return a.select("conv_id", "turn", *[F.array_join(f"a.{c}", ",").alias(c) for c in ("declared", "missing", "unused")])


def quoted_terms(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.md5(T.websearch(T.query_terms(F.lower("text"), stop_terms=()))).alias("md5"))


def lexeme_splits(spark, d):
    term = F.concat("event_type", F.lit("-v"), F.col("user_id").cast("string"), F.lit(".x/"))
    return read(spark, d, "events").select("event_id", F.array_join(T.lexemes(F.array(term, F.lit("退款"))), " ").alias("lexemes"))


def answer_checks(spark, d):
    points = F.array(F.lit("T h e"), F.lit("that\n"), F.lit("Zzz"))
    sources = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("role", F.lit("none")))
    return _turns(spark, d).select("conv_id", "turn", F.round(evaluation.answer_point_recall(points, F.col("text")), 6).alias("points"), evaluation.source_recall(sources, F.array(F.lit("user"))).alias("sources"))


def json_candidates(spark, d):
    kind = F.col("event_id") % 3
    said = F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("See: "), "props", F.lit(" and [1, 2]"))).otherwise(F.lit("none here"))
    found = read(spark, d, "events").select("event_id", structured.json_candidate(said).alias("candidate"))
    return found.select("event_id", "candidate", F.coalesce(structured.is_json("candidate"), F.lit(False)).alias("valid"), structured.at_path("candidate", "$.k", "none").alias("k"))


def json_records(spark, d):
    e = read(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("type"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("user")).alias("s"))
    body = structured.without_nulls(F.col("s"))
    return e.select("event_id", body.alias("body"), F.md5(structured.server_sent_event(F.lit("r1"), F.col("event_id").cast("string"), F.col("s.type"), body)).alias("frame"))


def risk_totals(spark, d):
    risk = lambda n: F.concat(F.lit('{"title":"t","category":"api","level":"low","rationale":"r","citations":['), F.rtrim(F.repeat(F.lit('{"source_id":"s","excerpt":"x"},'), n), F.lit(",")), F.lit("]}"))
    said = F.concat(F.lit("["), risk(F.lit(0)), F.lit(","), risk((F.col("c_custkey") % 3).cast("int")), F.lit("]"))
    return spread(read(spark, d, "customer").select("c_custkey")).select("c_custkey", structured.risk_counts(structured.risk_list(said)["risks"]).alias("c")).select("c_custkey", "c.*")


def _sum_text():
    n = lambda c: F.col(c).cast("int").cast("string")
    return F.when(F.col("l_orderkey") % 5 == 0, F.lit("__import__('os')")).otherwise(F.concat(n("l_quantity"), F.lit(" * -("), n("l_linenumber"), F.lit(" - "), n("l_partkey"), F.lit(") / "), n("l_suppkey")))


def calculated(spark, d):
    line = read(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.round(structured.calculate(_sum_text()), 6).alias("value"), F.round(routing.safe_divide(F.col("l_quantity"), F.col("l_linenumber") - 3), 6).alias("ratio"))


def tool_calls(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.md5(providers.called(_chosen(("length", "normalize", "missing"), "turn"), F.col("text"))).alias("md5"))


def reference_ids(spark, d):
    document, index = F.col("conv_id").cast("string"), F.col("turn")
    messages = F.to_json(F.array(F.struct("role", F.col("text").alias("content"))))
    spans = F.array(F.struct(F.lit("e1").alias("element_id"), F.lit(0).alias("start_char"), F.length("text").alias("end_char")))
    return _turns(spark, d).select(
        "conv_id", "turn", identity.simple_chunk_id(document, index, F.col("text")).alias("simple_id"),
        identity.cache_key(F.lit("chat.dev_chat"), F.lit("m1"), messages).alias("cache_key"),
        identity.chunk_id(document, F.lit("v1"), F.lit("p1"), F.lit("standalone"), F.col("text"), spans).alias("chunk_id"),
        F.lit(identity.fusion_ref(60, ["lexical", "dense"])).alias("fusion_ref"), F.lit(identity.space_ref("local", "c1", "m1", 64, "1")).alias("space_ref"),
    )


def event_times(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    return read(spark, d, "events").select("event_id", values.iso_utc("ts").alias("iso"), values.parsed_time(F.when(F.col("event_id") % 2 == 0, F.concat(day, F.lit(" 10:20:30"))).otherwise(day)).cast("string").alias("parsed"))


def list_helpers(spark, d):
    b = read(spark, d, "benchmark").select("item_id", F.transform(F.split("text", " "), lambda w: F.length(w).cast("long")).alias("x"))
    keys = values.ordered_distinct("x")
    mapped = values.zipped(F.transform(keys, lambda k: k.cast("string")), F.transform(keys, lambda k: k % 5))
    sums = F.transform(values.pieces("x", 4), values.total)
    return b.select(
        "item_id", F.array_join(keys.cast("array<string>"), ",").alias("keys"), F.array_join(sums.cast("array<string>"), ",").alias("sums"), values.total(values.squares("x")).alias("squares"),
        F.size(values.evens("x")).alias("evens"), values.best_key(mapped).alias("best"), F.element_at(values.stringified(mapped), F.element_at(keys, 1).cast("string")).alias("first"),
    )


def subset_checks(spark, d):
    n = lambda by: F.col("c_nationkey") % by
    return read(spark, d, "customer").select("c_custkey", setops.is_subset(F.array(n(3), n(5)), F.array(n(2), F.lit(1))).alias("subset"), values.is_superset(F.array(n(4), n(6)), F.array(n(2))).alias("superset"))


def fibonacci_numbers(spark, d):
    return read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("region"), F.posexplode(values.fibonacci(30)).alias("n", "value"))


def selected_paths(spark, d):
    return _turns(spark, d).select("conv_id", "turn", routing.select_path("text", ("ould", "zz"), ("Th",)).alias("path"))


def evidence_outcomes(spark, d):
    e = read(spark, d, "events").select("event_id", routing.eligibility_outcome(_chosen(("current_evidence", "historical_context", "draft"), "user_id")).alias("o"))
    return e.select("event_id", "o.source_type", "o.outcome")


def event_gaps(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"))
    return routing.sequence_gaps(e).select("run_id", "sequence", "last")


def latest_events(spark, d):
    return tables.latest(read(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


def repeated_event_keys(spark, d):
    return tables.repeated_keys(read(spark, d, "events"), ["user_id", "event_type"])


def unbound_chunks(spark, d):
    chunks = read(spark, d, "documents").where("doc_id % 7 > 0").select(F.col("doc_id").alias("chunk_id"), (F.col("n_chars") % 3).cast("string").alias("text"))
    embeddings = read(spark, d, "documents").where("doc_id % 5 > 0").select(F.col("doc_id").alias("chunk_id"), (F.col("n_chars") % 6).cast("string").alias("text"))
    return tables.unbound(chunks, embeddings)


def embedding_spaces(spark, d):
    v = read(spark, d, "embeddings").select(F.lit("local").alias("provider"), F.concat(F.lit("m"), F.col("label") % 3).alias("model"), F.size("embedding").alias("dimensions"))
    return tables.one_space(v)


def source_listing(spark, d):
    return tables.document_ids(read(spark, d, "documents"), "source")


def golden_report(spark, d):
    some = lambda c, x: F.when(c, F.array(x)).otherwise(F.array().cast("array<string>"))
    c = read(spark, d, "labels").select((F.col("toxic") > 0).alias("should_refuse"), some(F.col("quality") > 0, F.col("doc_id").cast("string")).alias("retrieval_expected_chunk_ids"), some(F.col("doc_id") % 3 == 0, F.lit("s")).alias("expected_sources"))
    return records.golden_summary(c)


def bad_cases(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("strategy"), F.col("event_id").cast("string").alias("chunk_id"), F.col("event_id").alias("rank"), F.lit("f").alias("filename"), "value")
    key = F.col("case_id")
    want = e.groupBy("case_id", "strategy").agg(F.min_by("chunk_id", "rank").alias("top_chunk_id"), F.count(F.lit(1)).alias("n_all"), F.max_by("chunk_id", "rank").alias("last"))
    want = want.select("case_id", "strategy", "top_chunk_id", F.when(key % 2 == 0, F.col("n_all")).alias("count"), F.when(key % 3 == 0, F.lit(False)).alias("empty"), F.when(key % 4 == 0, F.lit("f")).alias("filename"), F.array("last").alias("must_include"), F.when(key % 5 == 0, F.lit(0.4)).alias("max_redundancy"), (key % 10 / 10).alias("redundancy"))
    return records.bad_case_checks(e.where("value <= 100").drop("value"), want).select("case_id", "strategy", "status", F.array_join("failures", ",").alias("failures"))


def attempts_made(spark, d):
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("config_index"), F.lit(a).alias("attempt")) for c, a in itertools.product((0, 1), (1, 2, 3))]))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey"), every.alias("x")).select("request_id", "o_custkey", "x.*")
    n = F.col("request_id") + F.col("o_custkey") * F.col("attempt") + F.col("config_index")
    o = o.select("request_id", "config_index", "attempt", (n % 3 == 0).alias("ok"), F.when(n % 3 == 1, "timeout").when(n % 3 == 2, F.when(n % 2 == 0, "rate_limit").otherwise("auth")).alias("error_code"))
    return hybrid.reliable_attempts(o).select("request_id", "config_index", "attempt", "ok", hybrid.backoff_seconds(F.col("attempt")).alias("backoff"))


def _part_scores(spark, d):
    """Parts as chunks that suppliers ask for: a score by quantity, a distance by discount."""
    line = read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("query_id"), F.col("l_partkey").alias("chunk_id"), "l_quantity", "l_discount")
    return line.groupBy("query_id", "chunk_id").agg(F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))


def fixed_hybrid_routes(spark, d):
    s = _part_scores(spark, d)
    of = lambda c: lambda: s.select("query_id", "chunk_id", F.col(c).alias("score"))
    config = hybrid.HybridConfig(lexical_candidate_k=8, dense_candidate_k=6, lexical_min_rank=40.0, dense_max_distance=0.0, final_top_k=4)
    found = hybrid.fixed_hybrid(of("quantity"), of("discount"), config).decisions()
    return found.select("query_id", "chunk_id", F.round("rrf_score", 8).alias("rrf_score"), "n_routes", "best_rank", "fusion_rank", "selected")


def engine_threshold(spark, d):
    dense = _part_scores(spark, d).select("query_id", "chunk_id", F.col("quantity").alias("score"))
    return hybrid.smart_retrieve(dense, hybrid.EngineConfig("threshold", top_k=5, candidate_k=7, score_threshold=45.0))


def engine_reranked(spark, d):
    s = _part_scores(spark, d)
    config = hybrid.EngineConfig("similarity", top_k=5, candidate_k=7, rerank=True, fetch_k=9, rerank_top_n=3)
    return hybrid.smart_retrieve(s.select("query_id", "chunk_id", F.col("quantity").alias("score")), config, rerank_score=F.col("discount"), texts=s.select("query_id", "chunk_id", "discount"))


_ALL = (prompt_audits, context_relevance, shown_contexts, numbered_sources, answer_source_labels, used_sources, picked_labels, lexical_overlaps, template_audits, quoted_terms, lexeme_splits, answer_checks, json_candidates, json_records, risk_totals, calculated, tool_calls, reference_ids, event_times, list_helpers, subset_checks, fibonacci_numbers, selected_paths, evidence_outcomes, event_gaps, latest_events, repeated_event_keys, unbound_chunks, embedding_spaces, source_listing, golden_report, bad_cases, attempts_made, fixed_hybrid_routes, engine_threshold, engine_reranked)
QUERIES = {f.__name__: f for f in _ALL}

_PICK = lambda options, key: f"([{', '.join(repr(x) for x in options)}])[{key} % {len(options)} + 1]"
_ONE_LINE = lambda x: _STRIP(f"regexp_replace({x}, '[{_W}]+', ' ', 'g')")
_LABELLED = "'so [S' || (length(text) % 3 + 1) || '] and [S' || (length(text) % 2 + 1) || '] or [S' || (length(text) % 3 + 1) || '], not [x1]'"
_DISTINCT = lambda x: f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"
_SAYS = lambda t, w: f"contains({t}, '{w}')"
_ASKED, _MET, _WORDS = (" + ".join(x) for x in zip(*[
    (f"({any_q})::int", f"(({any_q}) and ({any_c}))::int", f"case when ({any_q}) and ({any_c}) then {both} else 0 end")
    for any_q, any_c, both in [(" or ".join(_SAYS("q", w) for w in ws), " or ".join(_SAYS("c", w) for w in ws), " + ".join(f"({_SAYS('q', w)} and {_SAYS('c', w)})::int" for w in ws)) for _, ws in CONCEPTS]
]))
_TERMS = r"[A-Za-z][A-Za-z0-9_./:+#%-]*|\d+(?:\.\d+)*"
_PARTS = "p as (select l_suppkey % 10 as query_id, l_partkey as chunk_id, sum(l_quantity) as quantity, max(l_discount) as discount from lineitem group by all)"
_TRIES = "o as (select o_orderkey as request_id, c as config_index, a as attempt, o_orderkey + o_custkey * a + c as n from orders, (values (0, 1), (0, 2), (1, 1), (1, 2)) t(c, a))"

SQL = {
    "prompt_audits": f"with p as (select conv_id, turn, {_PICK(PROMPTS, 'turn')} || ' ' || text as p from conversations), f as (select conv_id, turn, {', '.join(f'''regexp_matches(p, '{x}') as "{n}"''' for n, x in prompting.AUDIT.items())} from p) select *, {' + '.join(f'''"{n}"::int''' for n in prompting.AUDIT)} as score from f",
    "context_relevance": f"""with t as (select doc_id, lower('{QUESTION}') as q, lower({_ONE_LINE('text')}) as c from documents), n as (select doc_id, c, {_ASKED} as asked, {_MET} as met, {_WORDS} as words, list_distinct(regexp_extract_all(q, '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(c, '[a-z0-9]+')) as b from t)
      select doc_id, case when c = '' then 0.0 else round(least(0.55 * met::double / asked + 0.2::double * len(list_intersect(a, b)) / len(a) + least(words * 0.08::double, 0.24), 0.98), 3) end as relevance from n""",
    "shown_contexts": f"with t as (select *, {_ONE_LINE('text')} as t from documents) select doc_id, md5(format('[S1] filename={{}} chunk={{}} retrieval_score={{:.3f}} context_score=0.500', source, doc_id % 7, n_chars / 8) || chr(10) || case when length(t) > 90 then rtrim(substring(t, 1, 87)) || '...' else t end) as md5 from t",
    "numbered_sources": "select doc_id, md5(case when doc_id % 2 = 0 then '[来源1] source=' || source || ' title=' || lang || ' content=' || text else '(empty)' end) as md5 from documents",
    "answer_source_labels": f"with l as (select conv_id, turn, regexp_extract_all({_LABELLED}, '\\[(S\\d+)\\]', 1) as l from conversations) select conv_id, turn, array_to_string({_DISTINCT('l')}, ',') as labels from l",
    "used_sources": "with l as (select *, length(text) % 3 + 1 as a, length(text) % 2 + 1 as b from conversations) select conv_id, turn, concat_ws(',', case a when 1 then role when 2 then 'other' end, case when a <> b then case b when 1 then role else 'other' end end) as used from l",
    "picked_labels": f"with t as (select *, regexp_replace(text, '[{_W}]+', '', 'g') as t from conversations) select conv_id, turn, case {' '.join(f'''when contains(t, '{x}') then '{x}' ''' for x in LABELS)} when t = '' then 'EMPTY' else substring(t, 1, 20) end as label from t",
    "lexical_overlaps": "select item_id, round(len(list_intersect(['the', 'one', 'that', 'erth', 'and', 'enst', 'this'], regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) / 7, 6) as overlap from benchmark",
    "template_audits": "select conv_id, turn, array_to_string(list_sort(['role', 'text', role || '_name']), ',') as declared, array_to_string(list_sort(['role', role || '_name']), ',') as missing, 'unused' as unused from conversations",
    "quoted_terms": f"""with s as (select conv_id, turn, regexp_extract_all(lower(text), '{_TERMS}') as s from conversations), t as (select conv_id, turn, flatten(list_transform(s, lambda x: case when regexp_full_match(x, '[a-z][a-z0-9]*(?:[_.:/+#%-][a-z0-9]+)+|[a-z]+\\d+|\\d{{3,}}') then [x, 'techid' || regexp_replace(x, '[^a-z0-9]+', '', 'g')] else [x] end)) as t from s)
      select conv_id, turn, md5(array_to_string(list_transform({_DISTINCT('t')}, lambda x: '"' || x || '"'), ' OR ')) as md5 from t""",
    "lexeme_splits": "select event_id, replace(event_type, '_', ' ') || ' v' || user_id || ' x 退款' as lexemes from events",
    "answer_checks": f"with t as (select *, lower(regexp_replace(text, '[{_W}]+', '', 'g')) as t from conversations) select conv_id, turn, round((contains(t, 'the')::int + contains(t, 'that')::int + contains(t, 'zzz')::int) / 3, 6) as points, case when turn % 3 = 0 then 1.0 else (role = 'user')::int / 2 end as sources from t",
    "json_candidates": "select event_id, case when event_id % 3 < 2 then props end as candidate, event_id % 3 < 2 as valid, case when event_id % 3 < 2 then json_extract_string(props, '$.k') else 'none' end as k from events",
    "json_records": """with b as (select *, '{"type":"' || event_type || '"' || case when user_id % 2 = 0 then ',"user":' || user_id else '' end || '}' as body from events)
      select event_id, body, md5('id: r1:' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || body || chr(10) || chr(10)) as frame from b""",
    "risk_totals": "select c_custkey, 2 as risks, 1 + (c_custkey % 3 = 0)::int as without_citation, c_custkey % 3 as claims from customer",
    "calculated": "select l_orderkey, l_linenumber, round(case when l_orderkey % 5 > 0 and l_suppkey <> 0 then l_quantity * -(l_linenumber - l_partkey) / l_suppkey end, 6) as value, round(case when l_linenumber = 3 then 0 else l_quantity / (l_linenumber - 3) end, 6) as ratio from lineitem",
    "tool_calls": f"select conv_id, turn, md5(case turn % 3 when 0 then length(text)::varchar when 1 then lower(regexp_replace(text, '[{_W}]+', '', 'g')) end) as md5 from conversations",
    "reference_ids": f"""with m as (select *, to_json(text)::varchar as j from conversations)
      select conv_id, turn, conv_id || ':' || turn || ':' || substring(sha1(text), 1, 12) as simple_id,
      sha256('{{"config_ref":"chat.dev_chat","context_fingerprint":null,"extra":{{}},"messages_hash":"' || sha256('[{{"content":' || j || ',"role":"' || role || '"}}]') || '","model":"m1","prompt_id":null,"prompt_version":null,"schema_version":null,"structured_mode":null,"temperature":null}}') as cache_key,
      'chunk_' || substring(sha256('{{"document_id":"' || conv_id || '","document_version":"v1","kind":"standalone","policy_fingerprint":"p1","source_spans":[{{"element_id":"e1","end_char":' || length(text) || ',"start_char":0}}],"text":' || j || '}}'), 1, 16) as chunk_id,
      'rrf@1.0.0:' || substring(sha256('{{"algorithm":"reciprocal_rank_fusion","routes":["dense","lexical"],"rrf_k":60,"version":"1.0.0"}}'), 1, 16) as fusion_ref,
      'embedding-space@1:' || substring(sha256('{{"config_ref":"c1","dimensions":64,"model":"m1","preprocessing_version":"1","provider":"local"}}'), 1, 16) as space_ref from m""",
    "event_times": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+00:00') as iso, case when event_id % 2 = 0 then strftime(ts, '%Y-%m-%d') || ' 10:20:30' end as parsed from events",
    "list_helpers": f"""with x as (select item_id, list_transform(string_split(text, ' '), lambda w: length(w)) as x from benchmark), k as (select *, {_DISTINCT('x')} as k, list_max(list_transform(x, lambda v: v % 5)) as m from x)
      select item_id, array_to_string(k, ',') as keys, array_to_string(list_transform(range(0, len(x), 4), lambda i: list_sum(x[i + 1:i + 4])::bigint), ',') as sums, list_sum(list_transform(x, lambda v: v * v)) as squares, len(list_filter(x, lambda v: v % 2 = 0)) as evens, list_min(list_transform(list_filter(k, lambda v: v % 5 = m), lambda v: v::varchar)) as best, (k[1] % 5)::varchar as first from k""",
    "subset_checks": "select c_custkey, list_has_all([c_nationkey % 2, 1], [c_nationkey % 3, c_nationkey % 5]) as subset, list_has_all([c_nationkey % 4, c_nationkey % 6], [c_nationkey % 2]) as superset from customer",
    "fibonacci_numbers": "with recursive f(n, a, b) as (select 0, 0::bigint, 1::bigint union all select n + 1, b, a + b from f where n < 29) select r_regionkey as region, n, a as value from region, f",
    "selected_paths": "select conv_id, turn, case when contains(text, 'ould') or contains(text, 'zz') then 'tool' when contains(text, 'Th') then 'retrieval' else 'plain' end as path from conversations",
    "evidence_outcomes": "select event_id, (['evidence', 'history_review', 'other'])[user_id % 3 + 1] as source_type, case when user_id % 3 = 2 then 'excluded' else 'mapped' end as outcome from events",
    "event_gaps": "select user_id as run_id, event_id as sequence, lag(event_id) over w as last from events window w as (partition by user_id order by event_id) qualify last is not null and sequence <> last + 1",
    "latest_events": "select user_id, event_type, max(event_id) as event_id from events group by all",
    "repeated_event_keys": "select user_id, event_type, count(*) as n from events group by all having n > 1",
    "unbound_chunks": """select doc_id as chunk_id, case when doc_id % 7 = 0 then 'no_chunk' when doc_id % 5 = 0 then 'no_embedding' else 'other_text' end as reason from documents
      where (doc_id % 7 > 0 or doc_id % 5 > 0) and (doc_id % 7 = 0 or doc_id % 5 = 0 or n_chars % 3 <> n_chars % 6)""",
    "embedding_spaces": "select distinct 'local' as provider, 'm' || (label % 3) as model, len(embedding) as dimensions from embeddings",
    "source_listing": "select distinct source from documents",
    "golden_report": "select count(*) as total_cases, count(*) filter (quality > 0) as retrieval_cases, count(*) filter (toxic <= 0) as answerable_cases, count(*) filter (toxic > 0) as refusal_cases, count(*) filter (doc_id % 3 = 0) as cases_with_expected_sources from labels",
    "bad_cases": """with x as (select user_id, event_type, min(event_id) as top, max(event_id) as last, count(*) as n from events group by all), g as (select user_id, event_type, min(event_id) as gtop, count(*) as gn, list(event_id) as ids from events where value <= 100 group by all),
      f as (select x.user_id as case_id, x.event_type as strategy, concat_ws(',', case when gtop is distinct from top then 'top_chunk_id' end, case when case_id % 2 = 0 and coalesce(gn, 0) <> n then 'count' end, case when case_id % 3 = 0 and gn is null then 'empty' end,
        case when case_id % 4 = 0 and gn is null then 'filename' end, case when not coalesce(list_contains(ids, last), false) then 'must_include' end, case when case_id % 5 = 0 and case_id % 10 > 4 then 'max_redundancy' end) as failures from x left join g using (user_id, event_type))
      select case_id, strategy, case when failures = '' then 'pass' else 'fail' end as status, failures from f""",
    "attempts_made": f"""with {_TRIES}, m as (select *, coalesce(bool_and(n % 3 = 1 or (n % 3 = 2 and n % 2 = 0)) over (partition by request_id order by config_index, attempt rows between unbounded preceding and 1 preceding), true) as made from o)
      select request_id, config_index, attempt, n % 3 = 0 as ok, 0.5 * 2 ** (attempt - 1) as backoff from m where made""",
    "fixed_hybrid_routes": f"""with {_PARTS}, r as (select *, row_number() over (partition by query_id order by quantity desc, chunk_id) as l, row_number() over (partition by query_id order by discount, chunk_id) as e from p),
      u as (select query_id, chunk_id, l as rank from r where l <= 8 and quantity >= 40 union all select query_id, chunk_id, e from r where e <= 6 and discount <= 0),
      f as (select query_id, chunk_id, sum(1 / (60 + rank)) as s, count(*) as n_routes, min(rank) as best_rank from u group by all), o as (select *, row_number() over (partition by query_id order by s desc, n_routes desc, best_rank, chunk_id) as fusion_rank from f)
      select query_id, chunk_id, round(s, 8) as rrf_score, n_routes, best_rank, fusion_rank, fusion_rank <= 4 as selected from o""",
    "engine_threshold": f"with {_PARTS}, r as (select query_id, chunk_id, quantity as score, row_number() over (partition by query_id order by quantity desc, chunk_id) as rank from p) select * from r where rank <= 5 and score >= 45",
    "engine_reranked": f"""with {_PARTS}, r as (select *, row_number() over (partition by query_id order by quantity desc, chunk_id) as first_rank from p qualify first_rank <= 9)
      select query_id, chunk_id, discount as score, row_number() over (partition by query_id order by discount desc, first_rank) as rank from r qualify rank <= 3""",
}


def _context_sql() -> str:
    """Candidates by windows; then one source of every request at a time, with what is left of the budgets. Within one, a fold over the parts of its text."""
    tokens = lambda x: f"case when length({_STRIP(x)}) = 0 then 0 else greatest(1, length({_STRIP(x)}) // 2) end"
    kinds = "['business_rule', 'api_doc', 'history', 'agent_summary', 'other', 'evidence', 'client_note', 'tool_result']"
    fits = "not a.full and x.tokens <= a.room"
    room = f"(case when {fits} then a.room - x.tokens else a.room end)"
    kept = f"list_reduce(list_concat([{{'i': 0::bigint, 'tokens': 0::bigint, 'room': target, 'kept': []::bigint[], 'full': false}}], ordered), lambda a, x: {{'i': 0::bigint, 'tokens': 0::bigint, 'room': {room}, 'kept': case when {fits} then list_append(a.kept, x.i) else a.kept end, 'full': a.full or target - {room} >= 0.75 * target}}).kept"
    short = f"""case when len(kept) > 0 then array_to_string(list_transform(list_filter(parts, lambda p: list_contains(kept, p.i)), lambda p: p.t), chr(10)) when len(parts) > 0 then regexp_replace(substring(content, 1, greatest(40, 2 * target)), '[{_W}]+$', '') || '...' else content end"""
    return f"""with recursive {_BM25},
s as (select query_id, rank as place, chunk_id::varchar as source_id, {kinds}[rank] as kind, documents.text as content, [95, 90, 30, 55, 10, 80, 70, 45][rank] as weight, score, lang, source, benchmark.text as requirement from b join documents on doc_id = chunk_id join benchmark on item_id = query_id where rank <= 8),
k as (select *, case when kind in ('business_rule', 'api_doc', 'evidence', 'client_note') then 'evidence' when kind = 'tool_result' then 'agent_summary' else kind end as section, row_number() over (partition by query_id, lower(regexp_replace(content, '[{_W}]+', '', 'g')) order by weight desc) as of_content from s),
w as (select *, case when of_content > 1 then 'duplicate_content' end as early, row_number() over (partition by query_id, section order by weight desc) as nth,
  '[' || source_id || '] ' || kind || chr(10) || 'type: ' || kind || chr(10) || 'score: ' || printf('%.2f', score) || chr(10) || 'metadata: ' as head, 'lang=' || lang || ', source=' || source as pairs,
  list_filter(list_distinct(regexp_extract_all(requirement, '[A-Za-z0-9_./-]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}')), lambda x: length(x) > 1) as words from k),
t as (select query_id, source_id, words, list_transform({_LINES.replace('text', 'content')}, lambda x: {_STRIP('x')}) as ls from w where early is null),
g as (select query_id, source_id, words, unnest(list_filter(flatten(list_transform(ls, lambda x: case when length(x) <= 120 then [x] else list_transform(string_split(regexp_replace(x, '([。；;.!?？])', '\\1' || chr(1), 'g'), chr(1)), lambda y: {_STRIP('y')}) end)), lambda x: x <> '')) as t, generate_subscripts(list_filter(flatten(list_transform(ls, lambda x: case when length(x) <= 120 then [x] else list_transform(string_split(regexp_replace(x, '([。；;.!?？])', '\\1' || chr(1), 'g'), chr(1)), lambda y: {_STRIP('y')}) end)), lambda x: x <> ''), 1) as i from t),
p as (select query_id, source_id, list({{'i': i, 't': t}} order by i) as parts, list({{'i': i, 'tokens': greatest(1, length(t) // 2)::bigint, 'room': 0::bigint, 'kept': []::bigint[], 'full': false}} order by -len(list_filter(words, lambda x: contains(t, x))), i) as ordered from g group by all),
c as (select w.*, coalesce(parts, []) as parts, coalesce(ordered, []) as ordered, {tokens("head || pairs || chr(10) || content")} as tokens, {tokens('requirement')} as asked,
  row_number() over (partition by query_id order by case when early is not null then 0 when section = 'evidence' then 1 when section = 'history' then 2 when section = 'agent_summary' then 3 else 4 end, case when early is not null then place else nth end) as k from w left join p using (query_id, source_id)),
f as (select distinct query_id, 0::bigint as k, 1400 - asked as l, 650::bigint as e, 160::bigint as h, 120::bigint as ag, 20::bigint as o, ''::varchar as source_id, ''::varchar as kind, ''::varchar as section, ''::varchar as status, ''::varchar as reason, 0::bigint as tokens, ''::varchar as content from c
  union all
  select query_id, k, l - cost, case when section = 'evidence' then e - cost else e end, case when section = 'history' then h - cost else h end, case when section = 'agent_summary' then ag - cost else ag end, case when section = 'other' then o - cost else o end,
    source_id, kind, section, case when fit then 'included' else 'dropped' end, case when cut then 'compressed' when fit then 'whole' else coalesce(early, 'token_budget_exceeded') end, case when cut then n else tokens end, case when cut then short else content end
  from (select *, case when cut then n when fit then tokens else 0 end as cost from (select *, cut or (room > 0 and tokens <= room) as fit from (select *, coalesce(may and n < tokens and n <= room, false) as cut from
    (select *, greatest(1, length({_STRIP("head || 'compressed=true, ' || pairs || chr(10) || short")}) // 2) as n from (select *, case when may then {short} end as short from (select *, case when may then {kept} end as kept from
    (select *, room > 0 and tokens > target and target >= 48 as may from (select *, least(room, 180) as target from
    (select c.*, f.l, f.e, f.h, f.ag, f.o, case when early is not null then 0 else greatest(least(f.l, case c.section when 'evidence' then f.e when 'history' then f.h when 'agent_summary' then f.ag else f.o end), 0) end as room from f join c on c.query_id = f.query_id and c.k = f.k + 1))))))))))
select query_id::varchar as request_id, k as place, source_id, kind as source_type, section, status, reason, tokens, content, status = 'included' and kind in ('evidence', 'business_rule', 'api_doc', 'client_note') as citation from f where k > 0"""


SQL["context_pack"] = _context_sql()


def _chunk_sql(most: int = 96) -> str:
    """Blocks are packed behind their document's title, one after the other; what is too long is cut, one window after the other. Positions count from 0."""
    policy = chunking.ChunkPolicy("catalogue", "1", "structure_aware", most).fingerprint
    lead = lambda x: f"(length({x}) - length(regexp_replace({x}, '^[{_W}]+', '')))"
    trail = lambda x: f"(length({x}) - length(regexp_replace({x}, '[{_W}]+$', '')))"
    last = lambda x, marks: f"length(regexp_extract({x}, '(?s)^(.*[{marks}])', 1))"
    joint, marks = "chr(10) || chr(10)", ".!?。！？;；\\n"
    return f"""with recursive l as (select doc_id, unnest({_LINES}) as line, generate_subscripts({_LINES}, 1) as i from documents), m as (select *, {_STRIP("line")} = '' as blank from l),
s as (select *, sum(blank::int) over (partition by doc_id order by i) as island from m), n as (select doc_id, string_agg(line, chr(10) order by i) as t, min(i) as i from s where not blank group by doc_id, island),
e as materialized (select doc_id, t, row_number() over (partition by doc_id order by i) as b from n),
h as (select doc_id, t as title from e where b = 1),
k as (select doc_id, 2::bigint as b, 2::bigint as first, length(t)::bigint as long from e where b = 2
  union all
  select doc_id, b, case when fits then first else b end, case when fits then more else own end from (select *, greatest(1, (length(title) + 2 + more - {lead('title')} - {trail('t')}) // 2) <= {most} as fits from
    (select e.doc_id, e.b, k.first, e.t, h.title, length(e.t)::bigint as own, k.long + 2 + length(e.t) as more from k join e on e.doc_id = k.doc_id and e.b = k.b + 1 join h on h.doc_id = k.doc_id))),
p as (select doc_id, first, b, t from k join e using (doc_id, b) union all select doc_id, coalesce(first, 2), 1, title from h left join (select distinct doc_id, first from k) using (doc_id)),
el as (select *, length(t) as long, coalesce(sum(length(t) + 2) over (partition by doc_id, first order by b rows between unbounded preceding and 1 preceding), 0)::bigint as o from p),
g as materialized (select doc_id, first, string_agg(t, {joint} order by b) as t from el group by all),
whole as (select doc_id, first, 0::bigint as a, length(t)::bigint as z, t as piece from g where greatest(1, length({_STRIP('t')}) // 2) <= {most}),
w as (select doc_id, first, t, 0::bigint as pos, null::bigint as a, null::varchar as piece from g where greatest(1, length({_STRIP('t')}) // 2) > {most}
  union all
  select doc_id, first, t, pos + stop, case when inner_text <> '' then pos + {lead('rest')} end, inner_text from (select *, {_STRIP('substring(rest, 1, stop)')} as inner_text from
    (select *, case when size = length(rest) then size when {last('win', marks)} > 0 then half + {last('win', marks)} when {last('win2', _W)} > 0 then half + {last('win2', _W)} else size end as stop from
    (select *, substring(rest, half + 1, size - half) as win, substring(rest, half + 2, size - half) as win2 from (select *, greatest(1, size // 2) as half from
    (select *, case when length(tail) > {lead('tail')} then {lead('rest')} + {2 * most + 1} + {lead('tail')} else length(rest) end as size from
    (select *, substring(rest, {lead('rest')} + {2 * most + 2}) as tail from (select doc_id, first, t, pos, substring(t, pos + 1) as rest from w where pos < length(t)))))))) ),
c as (select * from whole union all select doc_id, first, a, a + length(piece), piece from w where a is not null),
sp as (select c.doc_id, c.first, c.a, string_agg('{{"element_id":"' || c.doc_id || '-' || b || '","end_char":' || (greatest(0, a - o) + least(o + long, z) - greatest(o, a)) || ',"start_char":' || greatest(0, a - o) || '}}', ',' order by b) as spans
  from c join el using (doc_id, first) where greatest(o, a) < least(o + long, z) group by all)
select doc_id::varchar as document_id, row_number() over (partition by doc_id order by first, a) as ordinal, greatest(1, length({_STRIP('piece')}) // 2) as token_count,
  'chunk_' || sha256('{{"document_id":"' || doc_id || '","document_version":"1","kind":"standalone","policy_fingerprint":"{policy}","source_spans":[' || spans || '],"text":' || to_json(piece)::varchar || '}}')[1:16] as chunk_id from c join sp using (doc_id, first, a)"""


SQL["chunk_structure"] = _chunk_sql()
