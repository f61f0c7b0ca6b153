import hashlib
import math
import random

import numpy as np
import pytest

from granary.llm import codes

NAMES = ("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """One number at a time."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[tuple((v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(p, w):
        return min((sum((a - b) ** 2 for a, b in zip(w, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = {}
        for c in cut:
            for p, w in enumerate(c):
                groups.setdefault((p, best(p, w)[1]), []).append(w)
        for (p, k), ws in groups.items():
            books[p][k] = tuple(sum(x) // len(ws) for x in zip(*ws))
    out, sums = [], {}
    for (i, _, label), c in zip(kept, cut):
        found = [best(p, w) for p, w in enumerate(c)]
        out.append([i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)])
        sums[label] = sums.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(*r, sums[r[1]], digest) for r in out]


def table(spark, rows, n=5):
    return spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code int, `a.b` int").repartition(n)


def exact(rows):
    return [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def found(df):
    assert set(df.columns) == set(NAMES)
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_brute_force(spark):
    r = random.Random(5)
    rows = exact([(i, [r.gauss(0, 1) for _ in range(32)], r.choice([None, 1, 1, 1, 2, i])) for i in range(300)])
    assert found(codes.compress(table(spark, rows))) == sorted(brute(rows), key=str)


def test_odd_vectors(spark):
    r = random.Random(6)
    v = [r.uniform(-1, 1) for _ in range(16)]
    rows = exact([(1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] * 16, None), (4, [math.inf] + v[1:], 1), (5, v, None), (5, v, None), (5, v[::-1], 3), (None, v, 3), (7, [], 2), (8, v[:7], 2), (9, v + v[:5], 2), (10, [0.0] * 16, 1), (11, [-0.001] * 16, 1)])
    assert found(codes.compress(table(spark, rows, 3))) == sorted(brute(rows), key=str)
    one = exact([(3, v, 1)])
    assert found(codes.compress(table(spark, one))) == brute(one)
    assert found(codes.compress(table(spark, rows[:4]))) == []
    assert found(codes.compress(table(spark, rows).limit(0))) == []
    no_label = codes.compress(table(spark, rows, 2).drop("label"))
    assert {r["label_error"] for r in no_label.collect()} == {sum(x[3] for x in brute(rows))}


def test_ties_and_hot_labels(spark):
    rows = exact([(i, [float(i % 3)] * 16, 7 if i % 3 else i) for i in range(3000)])
    got = found(codes.compress(table(spark, rows, 6), entries=8, rounds=1))
    assert got == sorted(brute(rows, entries=8, rounds=1), key=str)


def test_very_long_and_large(spark):
    r = random.Random(8)
    rows = exact([(i, [r.uniform(-9000, 9000) for _ in range(3001)], 1) for i in range(9)])
    assert found(codes.compress(table(spark, rows), entries=4)) == sorted(brute(rows, entries=4), key=str)
    with pytest.raises(Exception, match="don't fit"):
        codes.compress(table(spark, [(1, [1e30] * 16, 1)])).collect()
    with pytest.raises(ValueError, match="two hexadecimal"):
        codes.fit(table(spark, rows), entries=300)


def test_distances_are_exact():
    r = np.random.default_rng(9)
    b = codes.limit(8)
    x, books = r.integers(-b, b, (50, 2, 4)), r.integers(-b, b, (2, 7, 4))
    code, far = codes.nearest(x, books)
    for i in range(50):
        for p in range(2):
            want = [sum((int(u) - int(w)) ** 2 for u, w in zip(x[i, p], e)) for e in books[p]]
            assert far[i, p] == min(want) and code[i, p] == want.index(min(want))


def test_codes_decode(spark):
    r = random.Random(10)
    rows = exact([(i, [r.uniform(-1, 1) for _ in range(16)], 1) for i in range(20)])
    df = table(spark, rows)
    books = codes.fit(df)
    by_id = dict((i, v) for i, v, _ in rows)
    for row in codes.encode(df, books).collect():
        back = codes.decode(row["code"], books)
        assert sum((math.floor(256 * x) - round(256 * y)) ** 2 for x, y in zip(by_id[row["vec_id"]], back)) == row["error"]
