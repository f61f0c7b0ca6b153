"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import identity, safety, segmentation, structured
from granary.functions import text as T
from granary.operators import chunking, evaluation, setops
from granary.plans.retrieval import read
from granary.sources import files


#: Latin letters written as CJK characters, so that texts without spaces between words can be had from any.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26))


def search_terms(spark, d):
    """Letters as CJK characters, cut by a dictionary of the benchmark's shorter words."""
    han = lambda c: F.translate(F.lower(c), LATIN, HAN)
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(han("text"), F.lit(f"[{HAN}]+"), F.lit(0))).alias("word")).where(F.length("word") <= 5).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    dictionary = segmentation.Dictionary.read(words)
    t = read(spark, d, "documents").select("doc_id", T.lexical_terms(han("text"), dictionary=dictionary).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("md5"))


def clean_text_actions(spark, d):
    out = T.clean_text(read(spark, d, "documents"), "text")
    return out.select("doc_id", F.md5("cleaned").alias("md5"), F.length("cleaned").alias("n"), F.array_join("actions", ",").alias("actions"))


def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalize_text("text")).alias("md5"))


def paragraph_blocks(spark, d):
    return files.text_blocks(read(spark, d, "documents")).select("doc_id", "block", "line_start", "line_end", F.md5("text").alias("md5"))


def redact_text(spark, d):
    c = read(spark, d, "conversations")
    docs = read(spark, d, "documents")
    return docs.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), F.md5(safety.redact_text("text")).alias("md5")).unionByName(c.select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), "turn", F.md5(safety.redact_text("text")).alias("md5")))


def redact_fields(spark, d):
    m = F.create_map(F.lit("token"), "event_type", F.lit("user-password"), "props", F.lit("k"), F.get_json_object("props", "$.k"))
    return read(spark, d, "events").select("event_id", safety.redact_map(m).alias("m")).select("event_id", F.col("m")["token"].alias("token"), F.col("m")["user-password"].alias("password"), F.col("m")["k"].alias("k"))


def injection_score(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", safety.injection_check("text").alias("x")).select("conv_id", "turn", "x.score", "x.blocked", F.size("x.reasons").alias("reasons"))


def classify_errors(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("Unauthorized: bad key", "Too many requests", "Read timed out", "Connection reset", "content policy", "context_length_exceeded", "odd")]), (F.col("event_id") % 7 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", safety.classify_error("event_type", said).alias("x")).select("event_id", "x.category", "x.retryable")


def lexical_terms(spark, d):
    t = read(spark, d, "documents").select("doc_id", T.lexical_terms(F.lower("text"), stop_terms=("the", "of", "de")).alias("t"))
    return t.select("doc_id", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("distinct_terms"), F.size(F.filter("t", lambda x: F.startswith(x, F.lit("techid")))).alias("technical"), F.md5(F.array_join("t", " ")).alias("md5"))


def bm25_tokens(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.md5(F.array_join(T.bm25_tokens("text"), "|")).alias("md5"))


def keyword_extraction(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.keywords("text")).alias("n"))


def segment_scores(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.posexplode(T.segments("text")).alias("i", "segment"))
    return s.select("doc_id", "i", F.length("segment").alias("n"), T.segment_score("segment", F.array(F.lit("the"), F.lit("que"), F.lit("der"))).alias("score"))


def sentence_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.sentences("text")).alias("sentences"))


def token_estimates(spark, d):
    return read(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("half"), T.estimate_tokens_mixed("text").alias("mixed"))


def preview_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.preview("text").alias("preview"))


def stream_pieces(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(T.stream_pieces("text")).alias("pieces"), F.element_at(T.stream_pieces("text"), 2).alias("second"))


def template_render(spark, d):
    t = F.lit("Hello {{ role }}, turn {{turn}} says {{ nothing }}.")
    return read(spark, d, "conversations").select("conv_id", "turn", T.render_template(t, {"role": F.col("role"), "turn": F.col("turn").cast("string")}).alias("out"), F.array_join(T.template_audit(t, F.array(F.lit("role"), F.lit("extra")))["missing"], ",").alias("missing"))


def log_lines(spark, d):
    e = read(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("value") > 50, " WARNING ").otherwise(" INFO "), F.col("event_type"), F.lit(" by "), F.col("user_id")).alias("line"))
    return e.select("event_id", T.log_fields("line").alias("x")).select("event_id", F.unix_seconds("x.time").alias("t"), "x.level", "x.message")


def level_counts(spark, d):
    return log_lines(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def dedupe_normalized_content(spark, d):
    return setops.distinct_content(read(spark, d, "documents").select("doc_id", "text"))


def element_ids(spark, d):
    x = read(spark, d, "documents")
    return x.select("doc_id", identity.element_id(F.col("doc_id").cast("string"), F.lit("v1"), F.lit(1), F.col("source"), F.col("text")).alias("element_id"), identity.simple_chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.col("text")).alias("chunk_id"))


def chunk_structure(spark, d):
    """Structure-aware chunks of all documents: the first block is the title."""
    b = files.text_blocks(read(spark, d, "documents"))
    e = b.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("1").alias("document_version"), F.concat_ws("-", F.col("doc_id").cast("string"), F.col("block").cast("string")).alias("element_id"), F.when(F.col("block") == 1, "title").otherwise("paragraph").alias("kind"), "text", F.col("block").alias("ordinal"))
    return chunking.chunk_documents(e, chunking.ChunkPolicy("catalogue", "1", "structure_aware")).select("document_id", "ordinal", "chunk_id", "token_count")


def char_windows(spark, d):
    w = chunking.split_documents(read(spark, d, "documents").select("doc_id", "text"))
    return w.select("doc_id", "chunk_index", "char_start", "char_end", F.md5("content").alias("md5"))


def token_stats_report(spark, d):
    c = read(spark, d, "documents").select("source", F.when(F.col("lang") == "en", "standalone").otherwise("child").alias("kind"), T.estimate_tokens("text").alias("token_count"))
    return evaluation.token_report(c, "source")


def risk_lists(spark, d):
    """Model answers made of turns: arrays, objects, fences, broken JSON, wrong levels."""
    q = F.concat(F.lit('{"title":"t'), F.col("turn"), F.lit('","category":"'), F.when(F.col("turn") % 3 == 0, "api").otherwise("other"), F.lit('","level":"'), F.when(F.col("turn") % 5 == 4, "severe").otherwise("low"), F.lit('","rationale":"r","citations":[{"source_id":"s"}]}'))
    n = F.col("conv_id") % 6
    said = F.when(n == 0, q).when(n == 1, F.concat(F.lit("["), q, F.lit("]"))).when(n == 2, F.concat(F.lit('```json\n{"risks":['), q, F.lit("]}\n```"))).when(n == 3, F.lit("  ")).when(n == 4, F.lit("[1")).otherwise(F.lit("12"))
    r = read(spark, d, "conversations").select("conv_id", "turn", structured.risk_list(said).alias("x"))
    return r.select("conv_id", "turn", "x.ok", "x.error_stage", F.coalesce(F.size("x.risks"), F.lit(0)).alias("risks"))


_W = r"\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_H = _W.replace(r"\t-\r", r"\t\x0b-\r")  # all but a line feed
_STRIP = lambda x: f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"
_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '[{_H}]+\\n', chr(10), 'g'), '[{_H}]+$', '')"
_REDACT = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)(api[_-]?key\\s*[:=]\\s*)([A-Za-z0-9_\\-]+)', '\\1***REDACTED***', 'g'), 'sk-[A-Za-z0-9_\\-]{{10,}}', 'sk-***REDACTED***', 'g'), '\\b1[3-9]\\d{{9}}\\b', '***PHONE***', 'g'), '\\b[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{{2,}}\\b', '***EMAIL***', 'g')"
_LINES = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')"
_MIXED = lambda x: f"((case when strlen(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')) > 0 then greatest(1, strlen(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')) // 4) else 0 end) + (case when length({x}) > strlen(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')) then greatest(1, floor((length({x}) - strlen(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'))) / 1.5)) else 0 end))::bigint"
_SIGNS = [(p.replace("|BEGIN_SYSTEM_PROMPT", ""), 2) for _, p in safety.INJECTION_SIGNS]
_HITS = ", ".join([f"case when regexp_matches(t, '{p}') then {n} else 0 end" for p, n in _SIGNS] + ["case when contains(t, 'api_key') or contains(t, 'password') or contains(t, 'secret') or contains(t, 'token') then 1 else 0 end"])

QUERIES = {f.__name__: f for f in (clean_text_actions, normalize_text, paragraph_blocks, redact_text, redact_fields, injection_score, classify_errors, lexical_terms, search_terms, bm25_tokens, keyword_extraction, segment_scores, sentence_counts, token_estimates, preview_text, stream_pieces, template_render, log_lines, level_counts, dedupe_normalized_content, element_ids, chunk_structure, char_windows, token_stats_report, risk_lists)}

_LAST = lambda mark: f"case when length(regexp_extract(win, '(?s)^(.*){mark.replace('.', '[.]').replace('?', '[?]')}', 1)) >= 90 then length(regexp_extract(win, '(?s)^(.*){mark.replace('.', '[.]').replace('?', '[?]')}', 1)) + {len(mark)} end"
_STOP = f"case when s + 180 >= n then n else s + coalesce({', '.join(map(_LAST, chunking.BREAKS))}, 180) end"

#: The best path from each place to the end, from the right; then the words of the path from the left, each after the words in it.
_SEARCH_TERMS = rf"""with recursive t as (select doc_id, translate(lower(text), '{LATIN}', '{HAN}') as t from documents),
  seg as (select doc_id, unnest(regexp_extract_all(t, '\d+(?:\.\d+)*|[{HAN}]+')) as s, generate_subscripts(regexp_extract_all(t, '\d+(?:\.\d+)*|[{HAN}]+'), 1) as k from t),
  runs as (select distinct s, length(s) as n from seg where s >= '{HAN[0]}'),
  dict as (select w, count(*) as f from (select unnest(regexp_extract_all(translate(lower(text), '{LATIN}', '{HAN}'), '[{HAN}]+')) as w from benchmark) where length(w) <= 5 group by w),
  total as (select ln(sum(f)::double) as lt from dict),
  places as (select s, n, unnest(range(1, n + 1)) as i from runs),
  known as (select s, i, len, f from (select s, i, unnest(range(1, least(5, n - i + 1) + 1)) as len from places) join dict on w = substring(s, i, len)),
  edges as (select * from known union all select s, i, 1 as len, 1 as f from places anti join known using (s, i)),
  v as (select s, n + 1 as i, [0.0::double] as best, []::bigint[] as lens from runs
    union all select v.s, v.i - 1, list_prepend(max({{'a': ln(f::double) - lt + best[len], 'len': len}}).a, best), list_prepend(max({{'a': ln(f::double) - lt + best[len], 'len': len}}).len, lens) from v join edges e on e.s = v.s and e.i = v.i - 1, total group by v.s, v.i, best, lens),
  path as (select s, 1 as i, lens from v where i = 1 union all select s, i + lens[i], lens from path where i <= len(lens)),
  words as (select s, i, substring(s, i, lens[i]) as w from path where i <= len(lens)),
  inside as (select s, i, 2 + size as kind, unnest(range(1, length(w) - size + 1)) as j, w, size + 1 as long from words, (values (1), (2)) z(size) where length(w) > size + 1),
  shown as (select s, i, kind, j, substring(w, j, long) as term from inside where substring(w, j, long) in (select w from dict) union all select s, i, 9, 0, w from words),
  cut as (select s, list(term order by i, kind, j) as terms from shown group by s),
  doc as (select doc_id, flatten(list(coalesce(terms, case when regexp_matches(seg.s, '^\d{{3,}}$') then [seg.s, 'techid' || seg.s] else [seg.s] end) order by k)) as ts from seg left join cut using (s) group by doc_id)
  select doc_id, coalesce(len(ts), 0) as n, coalesce(len(list_distinct(ts)), 0) as n_distinct, md5(coalesce(array_to_string(ts, ' '), '')) as md5 from documents left join doc using (doc_id)"""

SQL = {
    "search_terms": _SEARCH_TERMS,
    "char_windows": f"""with recursive r as (select doc_id, text, n, s as start, {_STOP} as stop from (select doc_id, text, length(text) as n, 0 as s, substring(text, 1, 180) as win from documents where text <> '')
      union all select doc_id, text, n, s, {_STOP} from (select *, substring(text, s + 1, 180) as win from (select doc_id, text, n, greatest(stop - 30, start + 1) as s from r where stop < n))),
      c as (select doc_id, start, substring(text, start + 1, stop - start) as c from r), p as (select doc_id, start + length(c) - length(regexp_replace(c, '^[{_W}]+', '')) as a, {_STRIP('c')} as c from c)
      select doc_id, row_number() over (partition by doc_id order by a, length(c)) - 1 as chunk_index, a as char_start, a + length(c) as char_end, md5(c) as md5 from p where c <> ''""",
    "clean_text_actions": f"""with a as (select doc_id, text, regexp_replace(text, '\\r\\n?', chr(10), 'g') as t1 from documents), b as (select *, replace(t1, chr(160), ' ') as t2 from a), c as (select *, nfc_normalize(t2) as t3 from b),
      d as (select *, {_TRIM("t3")} as t4 from c), e as (select *, regexp_replace(t4, '\\n{{3,}}', chr(10) || chr(10), 'g') as t5 from d), f as (select *, {_STRIP("t5")} as t6 from e)
      select doc_id, md5(t6) as md5, length(t6) as n, concat_ws(',', case when t1 <> text then 'normalize_newlines' end, case when t2 <> t1 then 'replace_non_breaking_space' end, case when t3 <> t2 then 'normalize_unicode_nfc' end, case when t4 <> t3 then 'trim_line_endings' end, case when t5 <> t4 then 'collapse_blank_lines' end, case when t6 <> t5 then 'trim_outer_whitespace' end) as actions from f""",
    "normalize_text": f"select doc_id, md5({_STRIP(_TRIM('regexp_replace(replace(text, chr(65279), ' + chr(39) * 2 + '), ' + chr(39) + chr(92) + 'r' + chr(92) + 'n?' + chr(39) + ', chr(10), ' + chr(39) + 'g' + chr(39) + ')'))}) as md5 from documents",
    "paragraph_blocks": f"""with l as (select doc_id, unnest({_LINES}) as line, generate_subscripts({_LINES}, 1) as i from documents), m as (select *, {_STRIP("line")} = '' as blank from l),
      s as (select *, sum(blank::int) over (partition by doc_id order by i) as island from m), b as (select doc_id, island, min(i) as line_start, max(i) as line_end, string_agg(line, chr(10) order by i) as text from s where not blank group by all)
      select doc_id, row_number() over (partition by doc_id order by line_start) as block, line_start, line_end, md5(text) as md5 from b""",
    "redact_text": f"select 'd' as kind, doc_id as id, 0::bigint as turn, md5({_REDACT('text')}) as md5 from documents union all select 'c', conv_id, turn, md5({_REDACT('text')}) from conversations",
    "redact_fields": "select event_id, '[REDACTED]' as token, '[REDACTED]' as password, json_extract_string(props, '$.k') as k from events",
    "injection_score": f"with t as (select conv_id, turn, lower({_STRIP('text')}) as t from conversations), h as (select conv_id, turn, [{_HITS}] as h from t) select conv_id, turn, list_sum(h) as score, list_sum(h) >= 3 as blocked, len(list_filter(h, lambda x: x > 0)) as reasons from h",
    "classify_errors": "select event_id, ['auth_error', 'rate_limit', 'timeout', 'network_error', 'safety_block', 'request_error', 'unknown_error'][event_id % 7 + 1] as category, event_id % 7 in (1, 2, 3) as retryable from events",
    "lexical_terms": r"""with s as (select doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_./:+#%-]*|\d+(?:\.\d+)*')) as s, generate_subscripts(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_./:+#%-]*|\d+(?:\.\d+)*'), 1) as i from documents),
      t as (select doc_id, i, 0 as j, s as t from s where s not in ('the', 'of', 'de') union all select doc_id, i, 1, 'techid' || regexp_replace(s, '[^a-z0-9]+', '', 'g') from s where regexp_full_match(s, '[a-z][a-z0-9]*(?:[_.:/+#%-][a-z0-9]+)+|[a-z]+\d+|\d{3,}')),
      g as (select doc_id, count(*) as terms, count(distinct t) as distinct_terms, count(*) filter (starts_with(t, 'techid')) as technical, md5(string_agg(t, ' ' order by i, j)) as md5 from t group by doc_id)
      select doc_id, coalesce(terms, 0) as terms, coalesce(distinct_terms, 0) as distinct_terms, coalesce(technical, 0) as technical, coalesce(md5, md5('')) as md5 from documents left join g using (doc_id)""",
    "bm25_tokens": f"""with t as (select item_id, regexp_replace(lower(text), '[{_W}\\x{{3000}}-\\x{{303f}}\\x{{ff00}}-\\x{{ffef}}，。！？、；：""''''（）【】]+', '', 'g') as t from benchmark)
      select item_id, md5(array_to_string(list_concat(list_transform(range(1, length(t) + 1), lambda i: substring(t, i, 1)), list_transform(range(1, length(t)), lambda i: substring(t, i, 2))), '|')) as md5 from t""",
    "keyword_extraction": r"select doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_./-]+|[\x{4e00}-\x{9fff}]{2,8}')), lambda x: length(x) > 1)) as n from documents",
    "segment_scores": f"""with l as (select doc_id, list_transform({_LINES}, lambda x: {_STRIP("x")}) as ls from documents),
      p as (select doc_id, list_filter(flatten(list_transform(ls, lambda x: case when length(x) <= 120 then [x] else list_transform(string_split(regexp_replace(x, '([。；;.!?？])', '\\1' || chr(1), 'g'), chr(1)), lambda y: {_STRIP("y")}) end)), lambda x: x <> '') as ss from l),
      s as (select doc_id, unnest(ss) as segment, generate_subscripts(ss, 1) - 1 as i from p) select doc_id, i, length(segment) as n, contains(segment, 'the')::int + contains(segment, 'que')::int + contains(segment, 'der')::int as score from s""",
    "sentence_counts": f"""select doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([。！？.!?])[{_W}]+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {_STRIP("x")}), lambda x: x <> '')) as sentences from documents""",
    "token_estimates": f"select doc_id, case when length({_STRIP('text')}) = 0 then 0 else greatest(1, length({_STRIP('text')}) // 2) end as half, {_MIXED('text')} as mixed from documents",
    "preview_text": f"with t as (select doc_id, {_STRIP(f'regexp_replace(text, ' + chr(39) + '[' + _W + ']+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} as t from documents) select doc_id, case when length(t) > 120 then substring(t, 1, 120) || '...' else t end as preview from t",
    "stream_pieces": "select conv_id, turn, (length(text) // 18) * 4 + case when length(text) % 18 = 0 then 0 when length(text) % 18 <= 4 then 1 when length(text) % 18 <= 9 then 2 when length(text) % 18 <= 12 then 3 else 4 end as pieces, substring(text, 5, 5) as second from conversations",
    "template_render": "select conv_id, turn, 'Hello ' || role || ', turn ' || turn || ' says .' as out, 'nothing,turn' as missing from conversations",
    "log_lines": "select event_id, epoch(date_trunc('second', ts))::bigint as t, case when value > 50 then 'WARNING' else 'INFO' end as level, event_type || ' by ' || user_id as message from events",
    "level_counts": "select case when value > 50 then 'WARNING' else 'INFO' end as level, count(*) as n from events group by 1",
    "dedupe_normalized_content": f"with k as (select doc_id, lower(regexp_replace(text, '[{_W}]+', '', 'g')) as k from documents) select min(doc_id) as doc_id, count(*) as copies from k group by k",
    "element_ids": "select doc_id, 'element_' || sha256(concat_ws(chr(31), doc_id::varchar, 'v1', '1', source, text))[1:16] as element_id, doc_id || ':0:' || sha1(text)[1:12] as chunk_id from documents",
    "token_stats_report": f"""with t as (select source, case when lang = 'en' then 'standalone' else 'child' end as kind, case when length({_STRIP('text')}) = 0 then 0 else greatest(1, length({_STRIP('text')}) // 2) end as n from documents),
      g as (select source, list_sort(list(n)) as ns, count(*) filter (kind = 'standalone') as standalone_count, count(*) filter (kind = 'child') as child_count from t group by source)
      select source, len(ns) as chunk_count, standalone_count, 0 as parent_count, child_count, ns[1] as min_tokens, ns[len(ns)] as max_tokens, list_sum(ns) as total_tokens, ns[ceil(len(ns) * 0.95)::int] as p95_tokens, ns[len(ns) // 2 + 1] as median_tokens from g""",
    "risk_lists": """select conv_id, turn, conv_id % 6 < 3 and turn % 5 <> 4 as ok, case when conv_id % 6 = 3 then 'empty' when conv_id % 6 in (4, 5) then 'json' when turn % 5 = 4 then 'schema' end as error_stage, case when conv_id % 6 < 3 and turn % 5 <> 4 then 1 else 0 end as risks from conversations""",
}
