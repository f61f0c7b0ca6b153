import hashlib
import random
import re

import pytest

from granary.llm.decontamination import PhraseIndex, contamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, width):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + width]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for x, ids in windows.items():
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    got |= ids
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,width,block", [(1, 13, 10**6), (2, 3, 7)])
def test_against_brute_force(spark, seed, width, block):
    r = random.Random(seed)
    vocabulary = ["A", "b", "éC", "d1", "the", "of", *[f"w{i}" for i in range(40)]]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, say(r.choice([1, 2, 5, 13, 20, 40]))) for i in range(12)] + [(3, say(4)), (50, ""), (51, None), (52, "..."), (53, "z z z z")]
    docs = [(i, " - ".join(r.choice([say(30), r.choice(items)[1] or "", (r.choice(items)[1] or "").upper(), "z z z z z"]) for _ in range(r.randint(0, 6)))) for i in range(80)]
    docs += [(None, docs[3][1]), (4, docs[5][1]), (6, docs[6][1]), (200, None), (201, ""), (202, "w1")]
    df, bm = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = contamination(df, bm, index=PhraseIndex(df, bm, width, block_terms=block))
    rows = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got.collect()), key=str)
    assert rows == brute(docs, items, width)


def test_proximity(spark):
    bm = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    df = spark.createDataFrame([(1, "alpha x beta gamma y delta"), (2, "alpha " + "x " * 30 + "beta gamma delta"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    index = PhraseIndex(df, bm)
    assert {r.doc_id for r in index.phrases().collect()} == {3}
    assert {r.doc_id for r in index.proximity().collect()} == {1, 3}


def test_empty(spark):
    bm = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination(df, bm).collect()] == [(1, 0, False)]
    assert contamination(df.where("false"), df.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_very_long_texts_and_odd_columns(spark):
    item = " ".join(f"q{i}" for i in range(15))
    long = "the of and " * 50_000
    rows = [(1, f"{long} {item} {long}", 1), (2, f"x {item}", 2), (3, long, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int").selectExpr("*", "map('a', 1) as terms", "2 as tag", "3 as `a.b`", "'w' as window")
    bm = spark.createDataFrame([(7, item, "z"), (8, "of", "z")], "item_id long, text string, doc_id string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(df, bm).collect()}
    assert got == {1: (300_015, 100_015, 2, True), 2: (16, 15, 1, True), 3: (150_000, 50_000, 1, True)}
