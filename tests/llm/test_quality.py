import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import quality


def corpus(seed, n=600):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        kind = r.choice(["good"] * 6 + ["toxic", "junk"])
        w = r.choices(common, weights=[1 / (j + 1) for j in range(200)], k=r.randint(30, 200))
        if kind == "toxic":
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["vile", "scummy", "nasty"])
        text = "%% ".join(w) if kind == "junk" else " ".join(w)
        docs.append((i, text, kind))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1)
    df = spark.createDataFrame([(i, t, 0) for i, t, _ in docs], "doc_id long, text string, key int").repartition(3)
    kept = {r.doc_id for r in quality.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held_out = [(i, k) for i, _, k in docs if i % 2 == 0]
    good = [i in kept for i, k in held_out if k == "good"]
    bad = [i not in kept for i, k in held_out if k != "good"]
    assert np.mean(good) > 0.95 and np.mean(bad) > 0.9


def brute_weights(docs, labels):
    """Log weights by plain counts, with a document's own counts taken off."""
    good = {i for i, q, t in labels if q and not t}
    grams = {}
    for i, t, *_ in docs:
        data = np.frombuffer((t or "").encode(), np.uint8)
        grams[i] = quality.grams(data, np.array([0, len(data)]))[0]
    raw, target = Counter(np.concatenate(list(grams.values())).tolist()), Counter(np.concatenate([grams[i] for i in good]).tolist())
    share = target.total() / raw.total()
    out = {}
    for i, x in grams.items():
        out[i] = 0.0
        for b, own in Counter(x.tolist()).items():
            e, t = (raw[b] - own) * share, target[b] - own * (i in good)
            if abs(t - e) > 3 * (e * (1 - share) + 1) ** 0.5 and abs(target[b] - raw[b] * share) > 2 * (raw[b] * share * (1 - share) + 1) ** 0.5:
                out[i] += (2 * (1 + np.log(own)) if b < quality.PAIRS else own) * np.log((t + 1) / (e + 1))
    return out


def test_weights_and_draw_against_brute_force(spark):
    docs, labels = corpus(2, 120)
    docs += [(1000, None, ""), (1001, "", ""), (1002, "vile " * 30_000, "")]
    df, lb = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    _, scores = quality.fit(df, lb)
    noisy = scores.select("doc_id", "log_weight", quality.gumbel(7).alias("g")).collect()
    want = brute_weights(docs, labels)
    assert {r.doc_id: r.log_weight for r in noisy} == pytest.approx(want, rel=1e-6, abs=1e-6)
    key = {r.doc_id: want[r.doc_id] + r.g for r in noisy}
    for size in (0, 1, 40, 500):
        drawn = {r.doc_id for r in quality.resample(df, lb, size).collect()}
        assert drawn == set(sorted(key, key=key.get, reverse=True)[:size])
    good = np.array([q and not t for _, q, t in labels])
    look = {i: 1 / (1 + np.exp(-w) * (1 - good.mean()) / good.mean()) for i, w in want.items()}
    judged = np.array([look[i] for i, _, _ in labels])
    share = good.mean() + np.cov(good, judged, bias=True)[0, 1] / (judged.var() or 1) * (np.mean(list(look.values())) - judged.mean())
    assert quality.resample(df, lb).count() == round(share * len(docs))


def test_noise_is_gumbel(spark):
    x = np.sort([r.g for r in spark.range(4000).selectExpr("id as doc_id", "id * 7 as tag").select(quality.gumbel(1).alias("g")).collect()])
    assert np.abs(np.exp(-np.exp(-x)) - (np.arange(4000) + 0.5) / 4000).max() < 0.04


def test_kth_largest(spark):
    r = random.Random(3)
    x = [r.choice([r.gauss(0, 1), 1.5, -7.0]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    for k in (1, 7, 200, 400):
        assert quality.kth_largest(df, "v", k, cells=8) == sorted(x)[-k]


def test_edge_rows(spark):
    lb = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "x " * 5)], "doc_id long, text string")
    assert quality.resample(df, lb).count() == 4
    assert quality.resample(df.where("false"), lb).count() == 0
    assert quality.Model(quality.Labels(np.zeros(0, np.int64), np.zeros(0, bool)), np.zeros(0, np.int32), np.zeros(0), np.zeros(0), 0).log_weights(pa.array([1], pa.int64()), pa.array([None], pa.string())).tolist() == [0]


def test_clashing_and_odd_columns(spark):
    docs, labels = corpus(4, 60)
    df = spark.createDataFrame([(i, t, 1, "x", {"a": 1}, 2) for i, t, _ in docs], "doc_id long, text string, tag int, log_weight string, key map<string,int>, `a.b` int")
    lb = spark.createDataFrame([(*x, 5) for x in labels] + [(None, 1, 0, 5), (1, None, 0, 5)], "doc_id long, quality int, toxic int, text int")
    assert quality.resample(df, lb).columns == ["doc_id", "tag", "log_weight", "key", "kept"]
    assert quality.resample(df, lb).count() > 0
