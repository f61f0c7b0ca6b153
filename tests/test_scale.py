"""Steps that grow with their input: as little as that, and with the same results."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import structured
from granary.functions.segmentation import Dictionary
from granary.operators import chunking, evaluation, retrieval
from granary.sources import pdf


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    docs = [(i, [f"w{min(int(r.paretovariate(0.7)), 60)}" for _ in range(r.choice([1, 7, 30, 400]))]) for i in range(600)] + [(600, []), (601, None), (602, ["w1"] * 300)]
    questions = [(i, [f"w{r.randint(1, 70)}" for _ in range(r.randint(1, 6))]) for i in range(300)] + [(300, []), (301, ["nothing"]), (302, ["w1", "w1", "nothing"]), (303, None)]
    d = spark.createDataFrame(docs, "doc_id long, words array<string>").repartition(5)
    return spark.createDataFrame(questions, "query_id long, words array<string>"), retrieval.LexicalIndex.build(d, F.col("words")), d


def listed(df, *columns):
    return sorted(tuple(x) for x in df.select(*columns).collect())


def test_best_documents_are_those_of_all_pairs(corpus):
    q, index, _ = corpus
    order = lambda s, c: retrieval.top(s.withColumn("score", F.round(c, 6)), 4, F.desc("score"), F.asc("doc_id"))
    words = F.col("words")
    assert listed(retrieval.bm25_best(q, index, words, 4), "query_id", "doc_id", "score", "rank") == listed(order(retrieval.bm25(q, index, words), "bm25"), "query_id", "doc_id", "score", "rank")
    columns = ("query_id", "doc_id", "score", "matched", "rank")
    assert listed(retrieval.ts_rank_best(q, index, words, 4), *columns) == listed(order(retrieval.ts_rank(q, index, words), "fts_rank"), *columns)
    n = retrieval.ts_rank(q, index, words).groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"))
    assert listed(retrieval.asked_ts_rank(q, words).ends(index, q), "query_id", "matches") == listed(n, "query_id", "matches")


def test_hybrid_is_that_of_all_pairs(corpus):
    q, index, d = corpus
    words = F.col("words")
    routes = [f(q, index, words).select("query_id", F.col("doc_id").alias("chunk_id"), F.col(c).alias("score")) for f, c in ((retrieval.ts_rank, "fts_rank"), (retrieval.bm25, "bm25"))]
    plain = retrieval.weighted_hybrid(*routes, d.select(F.col("doc_id").alias("chunk_id")), 0.6).withColumn("hybrid", F.round("hybrid", 6))
    want = retrieval.top(plain, 4, F.desc("hybrid"), F.asc("chunk_id"))
    got = retrieval.hybrid_best(retrieval.asked_ts_rank(q, words), retrieval.asked_bm25(q, index, words), index, q, 4, 0.6)
    assert listed(got, "query_id", "doc_id", "hybrid", "rank") == listed(want, "query_id", "chunk_id", "hybrid", "rank")


def test_no_pairs_are_shuffled(spark, corpus):
    """Before, every pair of a question and a document that share a term was."""
    q, index, _ = corpus
    for found in (retrieval.bm25_best(q, index, F.col("words"), 4), retrieval.ts_rank_best(q, index, F.col("words"), 4)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan
    build = index.docs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in build and {"terms", "counts"} < set(index.docs.columns)


def test_metrics_make_each_side_once(spark):
    results = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1), (1, 5, 3)], "case_id int, chunk_id int, rank int")
    expected = spark.createDataFrame([(1, 6), (1, 7), (1, 6), (2, 9), (3, None)], "case_id int, chunk_id int")
    m = evaluation.retrieval_metrics(results, expected)
    assert listed(m, "case_id", "recall", "rr", "hit") == [(1, 0.5, 0.5, 1.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)]
    assert m._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_answers_are_parsed_once(spark):
    """Before, the plan held an answer's parse once for every place that reads it."""
    rows = [("[]",), ('```json\n{"risks": []}\n```',), ('{"title":"t","category":"api","level":"low","rationale":"r","citations":[{"source_id":"s"}]}',), ("[1",), ("  ",), (None,)]
    said = spark.createDataFrame(rows, "said string")
    found = said.select(structured.risk_list("said").alias("x")).select("x.ok", "x.error_stage", structured.risk_counts(F.col("x.risks")).alias("c"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 3 and plan.count("parse_json") <= 1
    assert [(r["ok"], r["error_stage"], r["c"]["risks"] if r["ok"] else None) for r in found.collect()[:5]] == [(True, None, 0), (True, None, 0), (True, None, 1), (False, "json", None), (False, "empty", None)]


def test_documents_are_chunked_in_batches(spark):
    """Before, each document was a group of its own, made and answered as a table."""
    rows = [("a", "1", f"a{i}", "paragraph" if i else "title", f"text {i}.", i) for i in (2, 0, 1)] + [(None, "1", "b0", "paragraph", "x", None)]
    e = spark.createDataFrame(rows, "document_id string, document_version string, element_id string, kind string, text string, ordinal int")
    chunks = chunking.chunk_documents(e, chunking.ChunkPolicy("p", "1", "structure_aware"))
    assert "FlatMapGroups" not in chunks._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["document_id"], r["text"], len(r["source_spans"])) for r in chunks.orderBy("document_id").collect()] == [(None, "x", 1), ("a", "text 0.\n\ntext 1.\n\ntext 2.", 3)]


def test_windows_are_passed_on_in_parts():
    """Before, all windows of a batch of documents were held at once."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "text": ["word " * 200_000] * 29 + [None]})
    parts = list(chunking.window_batches(iter([batch]), 180, 30, False))
    assert len(parts) > 3 and max(p.nbytes for p in parts) < 2 * chunking.PART
    one = chunking.char_windows("word " * 200_000)
    assert sum(p.num_rows for p in parts) == 29 * len(one)
    assert [x for p in parts for x, i in zip(p["char_start"].to_pylist(), p["doc_id"].to_pylist(), strict=True) if i == 7] == [a for a, _, _ in one]


def test_runs_are_cut_once(spark):
    """Before, every run of a batch became objects of its own."""
    words = Dictionary({"ab".translate({97: 0x4E00, 98: 0x4E01}): 3, chr(0x4E02): 2})
    run = chr(0x4E00) + chr(0x4E01) + chr(0x4E02)
    rows = spark.createDataFrame([(1, [run, "", run]), (2, None), (3, []), (4, [run])], "id int, runs array<string>").coalesce(1)
    cut = [run[:2], run[2]]
    column = words.column(F.col("runs"))
    assert "ArrowUDF" in type(column).__name__ or "ARROW" in rows.select(column)._jdf.queryExecution().executedPlan().toString().upper()
    assert [tuple(r) for r in rows.select("id", column.alias("t")).orderBy("id").collect()] == [(1, [cut, [], cut]), (2, None), (3, []), (4, [cut])]


def test_strings_are_read_as_a_whole():
    """Before, each character of a PDF moved the pen by a matrix."""
    font = pdf.Font(pdf.Document(b""), {"Subtype": "Type0"})
    font._map(b"2 beginbfchar\n<0001> <0061>\n<0002> <0020>\nendbfchar 1 beginbfchar <03> <00660069> % note\nendbfchar")
    assert font.read(b"\0\1\0\2\0\3\0\4\0\2") == ("a fi ", 5, 2, 2.5)


@pytest.mark.parametrize("operator", ["or", "and"])
def test_best_phrases_are_those_of_all_pairs(spark, operator):
    """Before, every pair of a question and a document with one of its lexemes was shuffled, with places."""
    r = random.Random(5)
    docs = [(i, [r.choice("abcdefg") for _ in range(r.choice([1, 3, 20, 300]))]) for i in range(60)] + [(100, []), (101, ["a"] * 700 + ["b"]), (102, ["c"] * 16400 + ["d", "e"]), (103, None)]
    asked = [(i, [[r.choice("abcdefgz") for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 3))]) for i in range(60)] + [(60, []), (61, [["a", "b", "a"]]), (62, [["d", "e"]]), (63, None), (64, [["b"], []])]
    q = spark.createDataFrame(asked, "query_id long, phrases array<array<string>>")
    index = retrieval.PositionalIndex.build(spark.createDataFrame(docs, "doc_id long, words array<string>").repartition(3), F.col("words"))
    every = retrieval.full_text(q, index, F.col("phrases"), operator).withColumn("score", F.round("fts_rank", 6)).persist()
    best = retrieval.AskedPhrases(q, F.col("phrases"), operator)
    columns = ("query_id", "doc_id", "score", "matched", "rank")
    assert listed(best.best(index, q, 4), *columns) == listed(retrieval.top(every, 4, F.desc("score"), F.asc("doc_id")), *columns)
    assert listed(best.counts(index, q), "query_id", "matches") == listed(every.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "n")
    assert "Aggregate" not in best.best(index, q, 4)._jdf.queryExecution().optimizedPlan().toString()
