import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(nodes):
    """The top, and for each node what stands left and right of its path."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


def brute(rows, change=lambda r: r):
    """rows: doc_id, source, lang, n_chars, text."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, *tree([leaf(r) for r in own])
    root, above = tree([trees[s][1] for s in sources])
    out = []
    for s, up in zip(sources, above):
        own, subroot, paths = trees[s]
        for place, (r, path) in enumerate(zip(own, paths)):
            v = leaf(change(r))
            for left, right in path + up:
                v = h(left, v, right)
            out.append((r[0], s, place, leaf(r), subroot, root, path + up, h(*[x + y for x, y in path + up]), v, v == root))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["source"], r["place"], r["leaf"], r["subroot"], r["root"], [(x["left"], x["right"]) for x in r["proof"]], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()), key=str)


def table(spark, rows, n=5):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, size int, `a.b` int").repartition(n)


def tampered(r):
    return (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)})) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r


def text():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def some(n, sources, seed=1):
    r = random.Random(seed)
    return [(r.choice([i, i, i, 3, None]), r.choice(sources), r.choice(["en", None]), r.choice([None, i]), r.choice([None, "", "Äb", "x=:y", f"Text {i}", "lower"])) for i in range(n)]


SOURCES = [None, "", "=", "a", "a", "a", "a", "a", "b=1", "é", "𝄞", "￮"]


@pytest.mark.parametrize("n", [1, 2, 17, 300])
def test_brute_force(spark, n):
    rows = some(n, SOURCES, n)
    assert found(merkle.manifest(table(spark, rows), {"text": text()})) == brute(rows, tampered)


def test_deep_trees(spark, monkeypatch):
    """Blocks of 16, so that trees of several heights go on in Spark; many sources, one of them hot."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = some(700, [*(f"s{i}" for i in range(40)), *["hot"] * 30, None, *["mid"] * 4], 7)
    assert found(merkle.manifest(table(spark, rows), {"text": text()})) == brute(rows, tampered)


def test_blocks_of_full_size(spark):
    rows = [(i, "one" if i % 40 else "other", "en", i, f"Text {i}") for i in range(4400)] + [(9999, "one", "en", 1, "Long " * 300_000)]
    assert found(merkle.manifest(table(spark, rows), {"text": text()})) == brute(rows, tampered)


def test_repeated_rows_and_none(spark):
    rows = [(1, "a", "en", 2, "Same")] * 40 + [(2, None, None, None, None)] * 3
    got = found(merkle.manifest(table(spark, rows, 3)))
    assert got == brute(rows) and all(r[-1] for r in got)
    assert found(merkle.manifest(table(spark, rows).limit(0))) == []


def test_proofs_that_were_kept(spark):
    rows = [(i, "ab"[i % 2], "en", i, f"Text {i}") for i in range(90)]
    kept = merkle.manifest(table(spark, rows))
    root = kept.first()["root"]
    now = [(*r[:4], "other") if r[0] % 7 == 0 else r for r in rows] + [(500, "a", "en", 1, "new"), (None, "a", "en", 1, "new")]
    got = {r["doc_id"]: r["verified"] for r in merkle.verify(table(spark, now), kept, root).collect()}
    assert got == {**{i: i % 7 != 0 for i in range(90)}, 500: False, None: False}
