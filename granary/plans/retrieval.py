"""Retrieval queries: the benchmark's items are the questions, the documents the corpus, label centroids the query vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import vector as V
from granary.operators import context, evaluation, retrieval
from granary.sources.tables import fingerprint, spread

WORDS = "[a-z0-9]+"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _words(c: str = "text"):
    return F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Indexes of this session, by kind and by what the documents' files were when they were made.
_MADE: dict[tuple, object] = {}


def _made(spark: SparkSession, d: str, make) -> object:
    """make(documents), once a session for the same files; changed files make a new one."""
    docs = read(spark, d, "documents")
    key = (spark.sparkContext.applicationId, make, d, fingerprint(docs))
    if key not in _MADE:
        _MADE[key] = make(spread(docs.select("doc_id", "text")), _words())
    return _MADE[key]


def _index(spark: SparkSession, d: str) -> retrieval.LexicalIndex:
    return _made(spark, d, retrieval.LexicalIndex.build)


def _bm25(spark: SparkSession, d: str, k: int, index: retrieval.LexicalIndex | None = None) -> DataFrame:
    return retrieval.bm25_best(_questions(spark, d), index or _index(spark, d), _words(), k).select("query_id", F.col("doc_id").alias("chunk_id"), "score", "rank")


def _fts(spark: SparkSession, d: str, k: int, index: retrieval.LexicalIndex | None = None) -> DataFrame:
    return retrieval.ts_rank_best(_questions(spark, d), index or _index(spark, d), _words(), k).select("query_id", F.col("doc_id").alias("chunk_id"), "score", "rank", "matched")


def visibility_prefilter(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("source_role"), F.create_map(F.lit("knowledge_scope"), "lang").alias("business_metadata"))
    return retrieval.visible(docs, scope="en", roles=("src1", "src2", "src3")).select("doc_id", "source_role", F.col("business_metadata")["knowledge_scope"].alias("scope"))


def bm25_topk(spark, d):
    return _bm25(spark, d, 5)


def bm25_bounded_topk(spark, d):
    """The same rows as bm25_topk, with common terms looked up in the candidates of rarer ones."""
    return retrieval.bm25_top(_questions(spark, d), _index(spark, d), _words(), 5).withColumnRenamed("doc_id", "chunk_id")


def ts_rank_topk(spark, d):
    return _fts(spark, d, 5)


def _places(spark: SparkSession, d: str) -> retrieval.PositionalIndex:
    return _made(spark, d, retrieval.PositionalIndex.build)


def phrase_topk(spark, d):
    """Terms of several lexemes: two neighbours of the item, two others the wrong way round, and a word, any of which may stand."""
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    q = _questions(spark, d).withColumn("w", _words()).select("query_id", F.array(F.concat(w(0), F.lit("_"), w(1)), F.concat(w(3), F.lit("-"), w(2)), w(4)).alias("terms"))
    asked, index = retrieval.AskedPhrases(q, T.phrases("terms")), _places(spark, d)
    return asked.best(index, q, 5).join(F.broadcast(asked.counts(index, q)), "query_id").select("query_id", "doc_id", "score", "matched", "rank", "matches")


def _place_all(docs: DataFrame, lexemes) -> retrieval.PositionalIndex:
    return retrieval.PositionalIndex.build(docs, lexemes, most_places=None, last_place=None)


def exact_phrase_topk(spark, d):
    """The whole question is one phrase, looked up in whole documents, and ranks by distances."""
    q = _questions(spark, d).select("query_id", F.array(_words()).alias("phrases"))
    return retrieval.AskedPhrases(q, F.col("phrases")).best(_made(spark, d, _place_all), q, 5).select("query_id", "doc_id", "score", "matched", "rank")


def all_phrases_topk(spark, d):
    """Two phrases that both must stand, anywhere in a document."""
    q = _questions(spark, d).withColumn("w", _words()).select("query_id", F.array(F.slice("w", 1, 2), F.slice("w", 4, 2)).alias("phrases"))
    return retrieval.AskedPhrases(q, F.col("phrases"), "and").best(_places(spark, d), q, 5).select("query_id", "doc_id", "score", "matched", "rank")


def fts_counts(spark, d):
    """Matches of each question, counted before the limit."""
    q = _questions(spark, d)
    s = retrieval.asked_ts_rank(q, _words()).ends(_index(spark, d), q)
    return q.select("query_id").join(s, "query_id", "left").select("query_id", F.coalesce("matches", F.lit(0)).alias("matches"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("query_vector"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def dense_topk(spark, d):
    return retrieval.dense_top(_centroids(spark, d), _vectors(spark, d), 10, digits=6)


def dense_visible_topk(spark, d):
    """Of the documents that may be seen, those whose vector (of the same number) is nearest to each centroid."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_role"), F.create_map(F.lit("knowledge_scope"), "lang").alias("business_metadata"))
    found = retrieval.dense_search(_centroids(spark, d), docs, _vectors(spark, d), 5, scope="en")
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "source_role")


def dense_threshold_report(spark, d):
    return retrieval.route_report(retrieval.threshold(retrieval.dense(_centroids(spark, d), _vectors(spark, d)), 0.75, False))


def centroid_pairs(spark, d):
    c = _centroids(spark, d)
    a, b = c.select(F.col("query_id").alias("a"), F.col("query_vector").alias("va")), c.select(F.col("query_id").alias("b"), F.col("query_vector").alias("vb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(V.cosine("va", "vb"), 6).alias("cosine"), F.round(V.dot("va", "vb"), 6).alias("dot"), F.round(V.euclidean("va", "vb"), 6).alias("euclidean"))


def _fused(spark, d):
    index = _index(spark, d)
    return retrieval.reciprocal_rank_fusion({"bm25": _bm25(spark, d, 20, index), "fts": _fts(spark, d, 20, index)})


def rrf_fusion(spark, d):
    return _fused(spark, d).where("fusion_rank <= 5").select("query_id", "fusion_rank", F.col("chunk_id").alias("doc_id"), F.round("rrf_score", 8).alias("rrf_score"), "n_routes")


def rrf_diagnostics(spark, d):
    return retrieval.fusion_diagnostics(_fused(spark, d))


def weighted_hybrid(spark, d):
    index, q = _index(spark, d), _questions(spark, d)
    s = retrieval.hybrid_best(retrieval.asked_ts_rank(q, _words()), retrieval.asked_bm25(q, index, _words()), index, q, 5, 0.6)
    return s.withColumnRenamed("doc_id", "chunk_id")


def rerank_f1(spark, d):
    c = F.broadcast(_bm25(spark, d, 20)).join(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body")), "chunk_id").join(_questions(spark, d), "query_id")
    s = c.select("query_id", "chunk_id", F.col("rank").alias("first_rank"), F.round(retrieval.token_f1(_words("text"), _words("body")), 6).alias("f1"))
    return retrieval.top(s, 5, F.desc("f1"), F.asc("first_rank"))


def mmr_select(spark, d):
    c = retrieval.dense_top(_centroids(spark, d), _vectors(spark, d), 20, "cosine")
    return retrieval.mmr(c.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")), "chunk_id"), 5)


def redundancy_by_label(spark, d):
    return retrieval.redundancy(read(spark, d, "embeddings").select(F.col("label").alias("query_id"), "embedding")).select("query_id", F.round("redundancy", 6).alias("redundancy"))


#: A small knowledge base of the catalogue: chunk, keywords.
KNOWLEDGE = (("k1", ("the", "that", "and")), ("k2", ("of", "with")), ("k3", ("que", "de", "el", "los")), ("k4", ("der", "die", "und")), ("k5", ("tion",)), ("k6", ("zzz", "the")))


def keyword_retrieve(spark, d):
    docs = spark.createDataFrame([(c, list(k)) for c, k in KNOWLEDGE], "chunk_id string, keywords array<string>")
    s = retrieval.keyword_scores(_questions(spark, d).withColumnRenamed("text", "question"), docs).withColumn("n", F.size("matched"))
    return retrieval.top(s, 2, F.desc("score"), F.desc("n"), F.desc("chunk_id")).select("query_id", "rank", "chunk_id", "score", "n")


def retrieval_metrics(spark, d):
    index = _index(spark, d)
    results = _bm25(spark, d, 5, index).withColumnRenamed("query_id", "case_id")
    return evaluation.retrieval_metrics(results, _fts(spark, d, 3, index).withColumnRenamed("query_id", "case_id")).select("case_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), "hit")


def retrieval_metric_means(spark, d):
    index = _index(spark, d)
    results = _bm25(spark, d, 5, index).withColumnRenamed("query_id", "case_id")
    m = evaluation.mean_metrics(evaluation.retrieval_metrics(results, _fts(spark, d, 3, index).withColumnRenamed("query_id", "case_id")))
    return m.select(F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.round("hit_rate", 6).alias("hit_rate"), "cases")


def context_pack(spark, d):
    q = _questions(spark, d)
    top = F.broadcast(_bm25(spark, d, 8)).join(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source"), "chunk_id")
    types = F.element_at(F.array(*[F.lit(t) for t in ("business_rule", "api_doc", "history", "agent_summary", "other", "evidence", "client_note", "tool_result")]), F.col("rank").cast("int"))
    sources = top.select(F.col("query_id").cast("string").alias("request_id"), F.col("rank").alias("place"), F.col("chunk_id").cast("string").alias("source_id"), types.alias("source_type"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), (1000 - F.col("rank")).alias("priority"), "score", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    return context.build_contexts(q.select(F.col("query_id").cast("string").alias("request_id"), F.col("text").alias("requirement")), sources, context.POLICIES["balanced"]).drop("shown")


def citation_membership(spark, d):
    c = read(spark, d, "conversations")
    claims = c.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("risk_index"), F.lit(1).alias("citation_index"), F.concat(F.lit("src"), F.length("text") % 30).alias("source_id"))
    allowed = read(spark, d, "documents").select(F.col("source").alias("source_id")).where("source_id != 'src7'")  # for all requests
    return context.citation_membership(claims, allowed)


def local_embedding(spark, d):
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.transform(V.local_embedding("text"), lambda x: F.round(x, 6)).alias("v"))


def vector_validity(spark, d):
    return read(spark, d, "embeddings").select("vec_id", V.is_valid("embedding", 64).alias("valid"), F.round(V.norm("embedding"), 6).alias("norm"), F.round(F.element_at(V.normalized("embedding"), 1), 6).alias("first"))


def min_max_scores(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), "o_orderkey", "o_totalprice")
    return retrieval.min_max_scaled(o, "o_totalprice").select("query_id", "o_orderkey", F.round("scaled", 6).alias("scaled"))


def no_result_reasons(spark, d):
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("big"))
    status = e.select("query_id", "route", (F.col("n") % 3 == 0).alias("failed"), (F.col("n") % 2).alias("visible"), (F.col("n") % 4).alias("candidates"), (F.col("big") % 2).alias("passed"), F.when(F.col("n") % 5 == 0, 1).otherwise(0).alias("final"))
    return retrieval.no_result_reason(status)


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_LISTS = f"""q as (select item_id as query_id, unnest({_TOKENS}) as term from benchmark),
dl as (select doc_id, {_TOKENS} as ts from documents), n as (select count(*) as n, avg(len(ts)) as avgdl from dl),
tf as (select doc_id, term, dl, count(*) as tf from (select doc_id, len(ts) as dl, unnest(ts) as term from dl) group by all)"""
_BM25 = f"""{_LISTS}, df as (select term, count(*) as df from tf group by term),
bs as (select query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as raw from q join tf using (term) join df using (term), n group by all),
b as (select query_id, doc_id as chunk_id, round(raw, 6) as score, row_number() over (partition by query_id order by round(raw, 6) desc, doc_id) as rank from bs)"""
_FTS = """qd as (select query_id, term, count(*) over (partition by query_id) as size from (select distinct query_id, term from q)),
fs as (select query_id, doc_id, sum(list_sum(list_transform(range(1, least(tf, 256) + 1), lambda j: 1.0::double / (j * j))) * 0.1 / 1.64493406685) / any_value(size) as raw, count(*) as matched from qd join tf using (term) group by all),
f as (select query_id, doc_id as chunk_id, round(raw, 6) as score, matched, row_number() over (partition by query_id order by round(raw, 6) desc, doc_id) as rank from fs)"""
_ROUTES = f"with {_BM25}, {_FTS}"
_RRF = f"""{_ROUTES}, r as (select query_id, chunk_id, rank from b where rank <= 20 union all select query_id, chunk_id, rank from f where rank <= 20),
g as (select query_id, chunk_id, sum(1.0::double / (60 + rank)) as s, count(*) as n_routes, min(rank) as best from r group by all),
o as (select *, row_number() over (partition by query_id order by s desc, n_routes desc, best, chunk_id) as fusion_rank from g)"""


def _phrase_sql(phrases: str, every: bool = False, whole: bool = False) -> str:
    """phrases: SQL of a question's phrases from its words w. Places, phrases that stand, then either rank. whole: all places count, and phrases are looked up in texts."""
    place, kept = ("i", "") if whole else ("least(i, 16383)", " qualify row_number() over (partition by doc_id, term order by p) <= 256")
    hit = """pt as (select distinct ph, unnest(ph) as term, generate_subscripts(ph, 1) as j from ph),
starts as (select distinct ph, doc_id, p - j as s, j from pt join pos using (term)),
hit as (select distinct ph, doc_id from (select ph, doc_id, s from starts group by all having count(distinct j) = len(ph))),"""
    if whole:
        hit = """dt as (select doc_id, ' ' || array_to_string(ts, ' ') || ' ' as t from dw), pl as (select distinct ph, ' ' || array_to_string(ph, ' ') || ' ' as t from ph),
hit as (select ph, doc_id from pl join dt on contains(dt.t, pl.t)),"""
    far = "abs(a.p - b.p)"
    near = f"case when {far} > 100 then 1e-30 else 1 / (1.005 + 0.05 * exp({far} / 1.5::double - 2)) end"
    return f"""with dw as (select doc_id, {_TOKENS} as ts from documents),
places as (select doc_id, term, {place} as p from (select doc_id, unnest(ts) as term, generate_subscripts(ts, 1) as i from dw)),
pos as (select doc_id, term, p from (select distinct doc_id, term, p from places){kept}),
lists as (select doc_id, term, list(p) as ps from pos group by all),
qw as (select item_id as query_id, {_TOKENS} as w from benchmark),
qp as (select query_id, list_distinct(list_filter({phrases}, lambda x: len(x) > 0)) as phs from qw),
ph as (select query_id, len(phs) as wanted, {"true" if every else "len(phs) = 1"} as all_must, unnest(phs) as ph from qp),
{hit}
stands as (select query_id, doc_id, any_value(all_must) as all_must from ph join hit using (ph) group by query_id, doc_id having case when any_value(all_must) then count(*) = any_value(wanted) else true end),
lx as (select distinct query_id, unnest(ph) as term from ph), sz as (select query_id, count(*) as n from lx group by all),
flat as (select query_id, doc_id, sum(list_sum(list_transform(range(1, len(ps) + 1), lambda j: 1.0::double / (j * j))) * 0.1 / 1.64493406685) as total, count(*) as matched from stands join lx using (query_id) join lists using (term, doc_id) group by all),
pr as (select st.query_id, st.doc_id, 1 - product(1 - 0.1 * sqrt({near})) as r from stands st join lx x on x.query_id = st.query_id join lx y on y.query_id = st.query_id and x.term < y.term
  join pos a on a.doc_id = st.doc_id and a.term = x.term join pos b on b.doc_id = st.doc_id and b.term = y.term where st.all_must and a.p <> b.p group by all),
sc as (select query_id, doc_id, round(case when st.all_must and n > 1 then coalesce(nullif(r, 0), 1e-20) else total / n end, 6) as score, matched from stands st join flat using (query_id, doc_id) join sz using (query_id) left join pr using (query_id, doc_id))
"""


_CENTROIDS = """c as (select label as query_id, list(x order by i) as qv from (select label, i, avg(x::double) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all) group by label)"""
_DENSE = f"with {_CENTROIDS}, s as (select query_id, vec_id as chunk_id, 1 - list_cosine_similarity(qv, embedding::double[]) as score from c, embeddings)"
_METRICS = f"""{_ROUTES}, e as (select query_id as case_id, chunk_id from f where rank <= 3), r as (select query_id as case_id, chunk_id, rank from b where rank <= 5),
h as (select case_id, count(distinct chunk_id) as found, min(rank) as first from r join e using (case_id, chunk_id) group by all),
m as (select case_id, coalesce(found, 0) / wanted as recall, coalesce(1.0::double / first, 0) as rr, case when first is null then 0.0::double else 1.0::double end as hit from (select case_id, count(*) as wanted from e group by all) left join h using (case_id))"""
_CONCEPTS = ", ".join("(" + " + ".join(f"contains(t, '{w}')::double" for w in words) + ")" for _, words in V.CONCEPTS)
_STOPS = ", ".join(f"'{w}'" for w in V.EMBEDDER_STOP_WORDS)

QUERIES = {f.__name__: f for f in (visibility_prefilter, bm25_topk, bm25_bounded_topk, ts_rank_topk, phrase_topk, exact_phrase_topk, all_phrases_topk, fts_counts, dense_topk, dense_visible_topk, dense_threshold_report, centroid_pairs, rrf_fusion, rrf_diagnostics, weighted_hybrid, rerank_f1, mmr_select, redundancy_by_label, keyword_retrieve, retrieval_metrics, retrieval_metric_means, context_pack, citation_membership, local_embedding, vector_validity, min_max_scores, no_result_reasons)}

SQL = {
    "visibility_prefilter": "select doc_id, source as source_role, lang as scope from documents where lang = 'en' and source in ('src1', 'src2', 'src3')",
    "bm25_topk": f"with {_BM25} select query_id, chunk_id, score, rank from b where rank <= 5",
    "bm25_bounded_topk": f"with {_BM25} select query_id, chunk_id, score, rank from b where rank <= 5",
    "ts_rank_topk": f"with {_LISTS}, {_FTS} select query_id, chunk_id, score, rank, matched from f where rank <= 5",
    "phrase_topk": f"""{_phrase_sql("[list_filter([w[1], w[2]], lambda x: x is not null), list_filter([w[4], w[3]], lambda x: x is not null), list_filter([w[5]], lambda x: x is not null)]")}
      select query_id, doc_id, score, matched, row_number() over (partition by query_id order by score desc, doc_id) as rank, count(*) over (partition by query_id) as matches from sc qualify rank <= 5""",
    "exact_phrase_topk": f"{_phrase_sql('[w]', whole=True)} select query_id, doc_id, score, matched, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc qualify rank <= 5",
    "all_phrases_topk": f"{_phrase_sql('[w[1:2], w[4:5]]', True)} select query_id, doc_id, score, matched, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc qualify rank <= 5",
    "fts_counts": f"with {_LISTS}, {_FTS} select item_id as query_id, count(chunk_id) as matches from benchmark left join f on query_id = item_id group by item_id",
    "dense_topk": f"{_DENSE} select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6), chunk_id) as rank from s qualify rank <= 10",
    "dense_visible_topk": f"""{_DENSE}, v as (select query_id, chunk_id, score, source as source_role from s join documents on doc_id = chunk_id where lang = 'en')
      select query_id, chunk_id, row_number() over (partition by query_id order by score, chunk_id) as rank, round(score, 6) as score, source_role from v qualify rank <= 5""",
    "dense_threshold_report": f"{_DENSE} select query_id, count(*) as candidates, count(*) filter (score <= 0.75) as passed, count(*) filter (score > 0.75) as dropped from s group by query_id",
    "centroid_pairs": f"with {_CENTROIDS} select x.query_id as a, y.query_id as b, round(list_cosine_similarity(x.qv, y.qv), 6) as cosine, round(list_dot_product(x.qv, y.qv), 6) as dot, round(list_distance(x.qv, y.qv), 6) as euclidean from c x join c y on x.query_id < y.query_id",
    "mmr_select": f"""with recursive {_CENTROIDS}, s as (select query_id, vec_id as chunk_id, embedding::double[] as v, list_cosine_similarity(qv, embedding::double[]) as score from c, embeddings),
      k as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 20),
      p as (select query_id, chunk_id, 1 as pick, [chunk_id] as taken, [v] as vs from k where rank = 1
        union all select query_id, k.chunk_id, pick + 1, list_append(taken, k.chunk_id), list_append(vs, k.v) from p join k using (query_id) where pick < 5 and not list_contains(taken, k.chunk_id)
        qualify row_number() over (partition by query_id order by 0.5 * k.score - 0.5 * list_max(list_transform(vs, lambda x: list_cosine_similarity(x, k.v))) desc, k.rank) = 1)
      select query_id, chunk_id, pick from p""",
    "rrf_fusion": f"{_RRF} select query_id, fusion_rank, chunk_id as doc_id, round(s, 8) as rrf_score, n_routes from o where fusion_rank <= 5",
    "rrf_diagnostics": f"{_RRF} select query_id, count(*) as distinct_candidates, count(*) filter (n_routes >= 2) as overlap from o group by query_id",
    "weighted_hybrid": f"""{_ROUTES}, a as (select item_id as query_id, documents.doc_id as chunk_id, coalesce(fs.raw, 0) as d, coalesce(bs.raw, 0) as l from benchmark cross join documents left join fs on fs.query_id = item_id and fs.doc_id = documents.doc_id left join bs on bs.query_id = item_id and bs.doc_id = documents.doc_id),
      z as (select *, min(d) over w as d0, max(d) over w as d1, min(l) over w as l0, max(l) over w as l1 from a window w as (partition by query_id)),
      h as (select query_id, chunk_id, round(0.6 * (case when d1 = d0 then 1 else (d - d0) / (d1 - d0) end) + 0.4 * (case when l1 = l0 then 1 else (l - l0) / (l1 - l0) end), 6) as hybrid from z)
      select *, row_number() over (partition by query_id order by hybrid desc, chunk_id) as rank from h qualify rank <= 5""",
    "rerank_f1": f"""with {_BM25}, t as (select query_id, chunk_id, b.rank as first_rank, list_distinct(regexp_extract_all(lower(benchmark.text), '[a-z0-9]+')) as x, list_distinct(regexp_extract_all(lower(documents.text), '[a-z0-9]+')) as y from b join benchmark on item_id = query_id join documents on doc_id = chunk_id where b.rank <= 20),
      s as (select *, len(list_intersect(x, y)) as k from t), f as (select query_id, chunk_id, first_rank, round(case when k = 0 then 0 else 2 * (k / len(x)) * (k / len(y)) / (k / len(x) + k / len(y)) end, 6) as f1 from s)
      select *, row_number() over (partition by query_id order by f1 desc, first_rank) as rank from f qualify rank <= 5""",
    "redundancy_by_label": "select a.label as query_id, round(avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) as redundancy from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by a.label",
    "keyword_retrieve": f"""with k as (select * from (values {", ".join(f"('{c}', [{', '.join(repr(w) for w in ws)}])" for c, ws in KNOWLEDGE)}) t(chunk_id, keywords)),
      m as (select item_id as query_id, chunk_id, len(list_filter(keywords, lambda w: contains(text, w))) as n, len(keywords) as size from benchmark, k)
      select query_id, row_number() over (partition by query_id order by round(n / size, 2) desc, n desc, chunk_id desc) as rank, chunk_id, round(n / size, 2) as score, n from m where n > 0 qualify rank <= 2""",
    "retrieval_metrics": f"{_METRICS} select case_id, round(recall, 6) as recall, round(rr, 6) as rr, hit from m",
    "retrieval_metric_means": f"{_METRICS} select round(avg(recall), 6) as recall, round(avg(rr), 6) as mrr, round(avg(hit), 6) as hit_rate, count(*) as cases from m",
    "citation_membership": """with c as (select conv_id::varchar as request_id, turn as risk_index, 1 as citation_index, 'src' || (length(text) % 30) as source_id from conversations)
      select *, case when source_id <> 'src7' and source_id in (select source from documents) then 'candidate' else 'unknown_source' end as status from c""",
    "local_embedding": f"""with n as (select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t from documents),
      b as (select *, list_transform(list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda w: not list_contains([{_STOPS}], w)), lambda w: ('0x' || sha1(w)[40])::int % 4) as bs from n),
      v as (select doc_id, [{_CONCEPTS}, {", ".join(f"len(list_filter(bs, lambda x: x = {i})) * 0.25" for i in range(4))}, 0, 0.3]::double[] as v from b)
      select doc_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) as v from v""",
    "vector_validity": "select vec_id, len(embedding) = 64 as valid, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, round(embedding[1] / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as first from embeddings",
    "min_max_scores": "select o_orderpriority as query_id, o_orderkey, round(case when max(o_totalprice) over w = min(o_totalprice) over w then 1 else (o_totalprice - min(o_totalprice) over w) / (max(o_totalprice) over w - min(o_totalprice) over w) end, 6) as scaled from orders window w as (partition by o_orderpriority)",
    "no_result_reasons": """with e as (select user_id as query_id, event_type, count(*) as n, count(*) filter (value > 50) as big from events group by all),
      a as (select query_id, max(case when n % 5 = 0 then 1 else 0 end) as final, bool_and(n % 3 = 0) as all_failed, bool_or(n % 3 = 0) as any_failed, max(n % 2) as visible, sum(n % 4) as candidates, sum(big % 2) as passed from e group by query_id)
      select query_id, case when final > 0 then null when all_failed then 'all_routes_failed' when any_failed then 'route_failure' when visible = 0 then 'visible_scope_empty' when candidates = 0 then 'no_route_match' when passed = 0 then 'all_below_threshold' else 'no_route_match' end as reason from a""",
}
