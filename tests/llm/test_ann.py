import numpy as np
import pytest

from granary.llm import ann


def brute(rows, every, k):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_exact_when_all_cells_are_searched(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=7).round(1)]) for i in range(300)] + [(i, [1.0] * 7) for i in range(300, 400)]
    bad = [(1000, None), (1100, [0.0] * 7), (1200, [float("nan")] * 7), (1300, [None] + [1.0] * 6), (None, [1.0] * 7), (1400, [1.0, 2.0]), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, label int").repartition(3)
    want = brute([(i, np.array(v, np.float32)) for i, v in rows], 50, 10)
    got = grouped(ann.nearest_neighbours(df, every=50, share=1.0, codes=4))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_lengths_ties_and_far_vectors(spark):
    """Each length by itself; distances beyond the largest double are infinite, and still ranked by id."""
    huge = 1e300
    rows = [(0, [huge, huge]), (1, [-huge, -huge]), (2, [-huge, -huge]), (3, [1.0]), (100, [2.0]), (4, [1.0]), (200, [1.0, 2.0, 3.0])]
    got = grouped(ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {0: [(1, float("inf")), (2, float("inf"))], 100: [(3, 1.0), (4, 1.0)]}


@pytest.mark.parametrize("n", [500, 2000, 6000])
def test_recall(spark, n):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, 20, 10)
    got = grouped(ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), every=20))
    assert all(len(x) == 10 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_regions_and_batches_are_bounded(spark):
    r = np.random.default_rng(5)
    x = np.concatenate((np.full((300, 4), 0.5), r.normal(size=(300, 4))))
    v = ann.usable(spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, embedding array<double>"))
    index = ann.MultiIndex(v, codes=8, block=40, batch=25)
    assert max(n for _, n in index.entries.groupBy("region").count().collect()) <= 80
    assert grouped(index.search(v.where("vec_id % 3 = 0"), 5, 1.0)).keys() == set(range(0, 600, 3))
    first, parts = ann.cell_regions(np.array([0, 5, 3, 30, 0, 9, 1]), 10)
    assert [(int(first[i]), int(parts[i])) for i in (1, 2, 3, 5, 6)] == [(0, 1), (0, 1), (1, 3), (4, 1), (4, 1)]


def test_blocks_split_a_hot_cell(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(500, [1.0, 3.0])]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = ann.MultiIndex(v, codes=2, block=50)
    got = grouped(index.search(v.where("vec_id % 100 = 0"), 3, 1.0))
    assert [i for i, _ in got[0]] == [1, 2, 3] and [i for i, _ in got[100]] == [0, 1, 2] and [i for i, _ in got[500]] == [0, 1, 2]


def test_order_of_cells():
    r = np.random.default_rng(3)
    a, b = r.random(6), r.random(5)
    got = list(ann.cells_in_order(a, b))
    assert len(set(got)) == 30 and [a[i] + b[j] for i, j in got] == sorted(a[i] + b[j] for i in range(6) for j in range(5))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest_neighbours(df).collect()] == [(0, 1)]
    assert ann.nearest_neighbours(df.where("false")).count() == 0
