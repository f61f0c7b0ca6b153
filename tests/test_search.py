"""Phrase search and dictionary segmentation, each against a plain version of its rules."""

import itertools
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.segmentation import Dictionary
from granary.operators import retrieval
from granary.plans import retrieval as plans


def plain_search(docs, phrases, every):
    """doc: rank of one query, position by position."""
    lexemes = list(dict.fromkeys(x for p in phrases for x in p))
    out = {}
    for doc, words in docs.items():
        at = {}
        for i, w in enumerate(words, 1):
            at.setdefault(w, set()).add(min(i, 16383))
        at = {w: sorted(p)[:256] for w, p in at.items()}
        stands = [any(all(s + j in at.get(w, ()) for j, w in enumerate(p)) for s in at.get(p[0], ())) for p in phrases]
        if not (all(stands) if every else any(stands)):
            continue
        if (every or len(phrases) == 1) and len(lexemes) > 1:
            left = 1.0
            for a, b in itertools.combinations([x for x in lexemes if x in at], 2):
                for p, q in itertools.product(at[a], at[b]):
                    d = abs(p - q)
                    if d:
                        left *= 1 - math.sqrt(0.1 * 0.1 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
            out[doc] = 1 - left
        else:
            out[doc] = sum(0.1 * sum(1 / j**2 for j in range(1, len(at[x]) + 1)) / 1.64493406685 for x in lexemes if x in at) / len(lexemes)
    return out


@pytest.mark.parametrize("operator", ["or", "and"])
def test_phrases(spark, operator):
    r = random.Random(11)
    docs = {i: [r.choice("abcdefg") for _ in range(r.choice([1, 3, 20, 300]))] for i in range(40)}
    docs |= {100: [], 101: ["a"] * 700 + ["b"], 102: ["c"] * 16400 + ["d", "e"], 103: ["source", "x", "channel"], 104: ["source", "channel"]}
    queries = {i: [[r.choice("abcdefgz") for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 3))] for i in range(40)}
    queries |= {100: [], 101: [["source", "channel"]], 102: [["source", "channel"], ["techidsourcechannel"]], 103: [["a", "b", "a"]], 104: [["d", "e"]]}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, words array<string>").repartition(3)
    q = spark.createDataFrame(list(queries.items()), "query_id long, phrases array<array<string>>")
    index = retrieval.PositionalIndex.build(d, F.col("words"))
    got = {(x["query_id"], x["doc_id"]): x["fts_rank"] for x in retrieval.full_text(q, index, F.col("phrases"), operator).collect()}
    want = {}
    for i, phrases in queries.items():
        distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
        if distinct:
            want |= {(i, doc): rank for doc, rank in plain_search(docs, distinct, operator == "and").items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(max(want[k], 1e-20), rel=1e-9, abs=1e-19) for k in want)
    assert (101, 104) in got and (101, 103) not in got


def test_terms_become_phrases(spark):
    row = spark.range(1).select(T.phrases(F.array(F.lit("source_channel"), F.lit("v2"), F.lit("售后"))).alias("p")).first()
    assert row["p"] == [["source", "channel"], ["v2"], ["售后"]]


def test_index_is_read_again(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a", "b"])], "doc_id long, words array<string>")
    retrieval.PositionalIndex.build(d, F.col("words"), folder=f"file://{tmp_path}/index")
    again = retrieval.PositionalIndex.load(spark, f"file://{tmp_path}/index")
    phrases = spark.createDataFrame([("x", ["a", "b"]), ("y", ["b", "a"]), ("z", ["a", "missing"])], "phrase_id string, lexemes array<string>")
    assert [tuple(x) for x in again.phrase_hits(phrases).collect()] == [("x", 1)]
    with pytest.raises(ValueError, match="operator"):
        retrieval.full_text(d.select(F.col("doc_id").alias("query_id")), again, F.array(), "xor")


ALPHABET = "一丁七万丈"


def paths(run):
    """All ways to cut a run."""
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        cuts = [0, *[i + 1 for i, m in enumerate(marks) if m], len(run)]
        yield [run[a:b] for a, b in itertools.pairwise(cuts)]


def test_best_path_of_all():
    r = random.Random(12)
    for _ in range(300):
        words = {"".join(r.choice(ALPHABET) for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(r.randint(1, 12))}
        d, run = Dictionary(words), "".join(r.choice(ALPHABET) for _ in range(r.randint(1, 9)))

        def weight(path):
            """None where a part is no word: a character alone may be none only if no word begins there."""
            out, at = 0.0, 0
            for p in path:
                begins = any(w in words for w in (run[at : at + k] for k in range(1, len(run) - at + 1)))
                if p not in words and (len(p) > 1 or begins):
                    return -math.inf
                out += math.log(words.get(p, 1)) - math.log(sum(words.values()))
                at += len(p)
            return out

        assert weight(d.cut(run)) == pytest.approx(max(map(weight, paths(run))))


def test_search_terms_and_domain_terms():
    d = Dictionary({"北京": 30, "大学": 40, "北京大学": 50, "京大": 2, "生": 9})
    assert d.search_terms("北京大学生") == ["北京", "京大", "大学", "北京大学", "生"]
    assert Dictionary({"北京": 3000, "大学": 4000, "生": 9}).cut("北京大学") == ["北京", "大学"]
    assert Dictionary({"北京": 3000, "大学": 4000, "生": 9}, ["北京大学"]).cut("北京大学生") == ["北京大学", "生"]
    assert d.cut("㐀北京鿿") == ["㐀", "北京", "鿿"]
    assert Dictionary({}).cut("北京") == ["北", "京"]
    assert d.cut("") == [] and len(d.cut("北京大学生" * 40_000)) == 80_000


def test_dictionary_in_columns(spark):
    words = spark.createDataFrame([("售后", 9), ("售后", 1), ("接口", 5), ("的", 50), (None, 3), ("", 3)], "word string, frequency int")
    d = Dictionary.read(words)
    texts = spark.createDataFrame([(1, "售后接口的 source_channel v2"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: r["x"] for r in texts.select("id", T.lexical_terms("t", dictionary=d).alias("x")).collect()}
    assert got == {1: ["售后", "接口", "source_channel", "techidsourcechannel", "v2", "techidv2"], 2: [], 3: None}
    with pytest.raises(ValueError, match="more than 2"):
        Dictionary.read(words, most=2)


def test_bounded_top_is_the_top(spark):
    """Common and rare terms, ties, questions that nothing or little answers, whatever is begun with."""
    r = random.Random(13)
    weights = [60, 40, 30, 10, 5, 3, 2, 1, 1, 1]
    docs = [(i, r.choices("abcdefghij", weights, k=r.choice([1, 5, 30]))) for i in range(300)] + [(1000 + i, ["a", "b"]) for i in range(20)]
    queries = [(i, r.choices("abcdefghijz", k=r.randint(1, 8))) for i in range(40)] + [(100, ["z"]), (101, []), (102, ["a"] * 4), (103, ["j", "a", "b", "c"])]
    q = spark.createDataFrame(queries, "query_id long, words array<string>")
    index = retrieval.LexicalIndex.build(spark.createDataFrame(docs, "doc_id long, words array<string>"), F.col("words"))
    plain = retrieval.bm25(q, index, F.col("words")).withColumn("score", F.round("bm25", 6))
    want = sorted(tuple(x) for x in retrieval.top(plain, 4, F.desc("score"), F.asc("doc_id")).select("query_id", "doc_id", "score", "rank").collect())
    for begin in (1, 50, 10**6):
        got = retrieval.bm25_top(q, index, F.col("words"), 4, begin=begin).select("query_id", "doc_id", "score", "rank")
        assert sorted(map(tuple, got.collect())) == want


def test_whole_questions_are_looked_up_in_whole_documents(spark, tmp_path):
    """Before, a question was its first four words, and a document's words from the 16,383rd on, and a word's from the 257th on, were not looked up."""
    asked = {1: "The one, two three four five SIX seven", 2: "only only", 3: "w0", 4: "", 5: None, 6: " ".join(f"x{i}" for i in range(300))}
    texts = {
        1: "the one two three four five six seven",
        2: "the one two three four five six",
        3: "the one two three",
        4: "pad " * 17_000 + asked[1],
        5: "the one two " * 300 + asked[1] + " three",
        6: "seven six five four three two one the",
        7: "only " * 400,
        8: "only x only",
        9: "w0 " * 300,
        10: "a " + asked[6] + " b",
        11: " ".join(f"x{i}" for i in range(299)),
        12: "",
        13: None,
    }
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = plans.exact_phrase_topk(spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert [x[:2] for x in got] == [(1, 1), (1, 4), (1, 5), (2, 7), (3, 9), (6, 10)]
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(plans.SQL["exact_phrase_topk"])
    assert [c[0] for c in want.description] == df.columns and sorted(want.fetchall()) == got


def test_near_places_meet_without_far_ones():
    """Before, every place of a lexeme met every one of another: 90 * 10**9 pairs here."""
    r = random.Random(3)
    for most in (30, 300, 3000):
        lists = [sorted({min(r.randint(1, most), most - 5) for _ in range(r.randint(1, 40))}) for _ in range(r.randint(2, 6))]
        left = 1.0
        for a, b in itertools.combinations(lists, 2):
            for d in (abs(p - q) for p, q in itertools.product(a, b) if p != q):
                left *= 1 - math.sqrt(0.1 * 0.1 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
        assert retrieval._near([np.array(x) for x in lists]) == pytest.approx(1 - left, rel=1e-9, abs=1e-12)
    assert retrieval._near([np.arange(1, 300_000) * 3 + i for i in range(2)]) == 1


def test_blocks_of_phrases_are_bounded_in_places(spark):
    """Before, a block had so many documents, however long."""
    q = spark.createDataFrame([(1, [["a", "b"]])], "query_id long, phrases array<array<string>>")
    asked = retrieval.AskedPhrases(q, F.col("phrases"))
    words = pa.RecordBatch.from_pydict({"doc_id": list(range(12)), "terms": [["a"] * (i * 100_000) + ["b"] for i in range(12)]})
    placed = pa.Table.from_batches(retrieval._placed(iter([words]), None, None)).combine_chunks().to_batches()
    blocks = list(asked.blocks(iter(placed)))
    assert len(placed) == 1 and len(blocks) > 2 and [i for ids, *_ in blocks for i in ids.to_pylist()] == list(range(12))
    assert [m for *_, matched in blocks for m in matched[:, 0]] == [0] + [2] * 11
