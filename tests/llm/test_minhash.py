import random
import re

import pytest

from granary.llm.components import connected_components
from granary.llm.minhash import near_duplicates


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)] + ["é", "ü,"]
    out = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 8)):  # copies drift away from one another
            base = base[:]
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                base[r.randrange(len(base))] = r.choice(vocabulary)
            out.append(r.choice([" ", "\n"]).join(base).upper() if r.random() < 0.2 else " ".join(base))
    r.shuffle(out)
    return [*out, "", None, " ", "a b", "A  B", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 5), (3, 2)])
def test_against_brute_force(spark, seed, k):
    rows = list(enumerate(corpus(seed), 10))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, words=k).collect()}
    assert got == brute(rows, k)


def test_edge_rows(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (4, "zz"), (9, text.upper()), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, 2, None, True), (4, 1, 4, True), (4, 2, 4, True), (4, 2, 4, True), (7, 0, 7, True), (9, 2, 4, False)]
    assert near_duplicates(df.where("false")).count() == 0


def test_texts_that_share_an_id_are_judged_each_by_its_own(spark):
    """Rows of brute force have numbers of their own; ids are looked up afterwards."""
    r = random.Random(8)
    texts = corpus(5)
    rows = [(r.randint(0, len(texts) // 3), t) for t in texts + texts[:20]]
    want = []
    found = brute(list(enumerate(t for _, t in rows)), 4)
    for i, (d, _) in enumerate(rows):
        component = min(rows[j][0] for j in found if found[j][1] == found[i][1])
        want.append((d, found[i][0], component, d == component))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in near_duplicates(df, words=4).collect()]
    assert sorted(got) == sorted(want)


def test_very_long_texts_and_odd_columns(spark):
    long = " ".join(str(i) for i in range(200_000))
    rows = [(1, long, 1, {"a": 1}, 2), (2, long.replace("777 ", "zz "), 1, {}, 2), (3, "a b c d e f", 1, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag int, component map<string,int>, `a.b` int")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randint(0, 50), r.randint(0, 50)) for _ in range(30)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}
