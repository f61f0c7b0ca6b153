import hashlib
import random
import re

import numpy as np
import pytest

from granary.llm import repeats
from granary.llm.automata import SuffixAutomaton, deduplicate_words
from granary.llm.suffixes import deduplicate_bytes

SCHEMA = "doc_id long, text string, h string, place string"


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["a", "bé", "cc", "d,", "the", "x" * 30]
    passages = [" ".join(r.choices(vocabulary, k=r.randint(15, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and out:
            out.append(r.choice(out))
        elif kind < 0.25:
            out.append("aa " * r.randint(1, 90))
        else:
            parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choices(vocabulary, k=r.randint(0, 40))) for _ in range(r.randint(0, 4))]
            out.append(r.choice([" ", "\n", "\t "]).join(parts))
    out += ["", None, " \n", "word", "z" * 400]
    return out


def brute(rows, width, split, join):
    """Rows in order of id: what is removed, by a dictionary of all windows."""
    seen, out = {}, {}
    units = [(d, split(t)) for d, t in rows]
    for d, u in units:
        for s in range(len(u) - width + 1):
            seen.setdefault(tuple(u[s : s + width]), (d, s))
    for d, u in units:
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - width + 1):
            if seen[tuple(u[s : s + width])] < (d, s):
                gone[s : s + width] = True
        kept = join([x for x, g in zip(u, gone) if not g])
        out[d] = (len(u), int(gone.sum()), hashlib.sha256(kept).hexdigest(), len(repeats.spans_of(gone)[0]))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("seed,width", [(1, 20), (2, 7)])
def test_words_against_brute_force(spark, seed, width):
    rows = list(enumerate(corpus(seed), 3))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    want = brute(rows, width, words, lambda k: " ".join(k).encode())
    for shard in (2000, 3):  # with few spans a shard, the grouped path settles most
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in deduplicate_words(df, width, shard).collect()}
        assert got == {d: w[:3] for d, w in want.items()}


@pytest.mark.parametrize("seed,width", [(3, 100), (4, 30)])
def test_bytes_against_brute_force(spark, seed, width):
    rows = list(enumerate(corpus(seed), 3))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    want = brute(rows, width, lambda t: list((t or "").encode()), bytes)
    for shard in (2000, 3):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256, r.n_spans) for r in deduplicate_bytes(df, width, shard).collect()}
        assert got == want


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (5, text), (5, "other"), (2, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in deduplicate_words(df).collect())
    assert got == [(-1, 0, 0), (-1, 50, 0), (2, 0, 0), (5, 1, 0), (5, 50, 0), (5, 50, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert deduplicate_words(empty).count() == 0 and deduplicate_bytes(empty).count() == 0
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in deduplicate_bytes(df).collect())
    assert got == [(-1, 0, 0), (-1, len(text), 0), (2, 0, 0), (5, 5, 0), (5, len(text), 0), (5, len(text), 0)]


def test_long_row_in_parts(monkeypatch, spark):
    r = random.Random(5)
    text = "".join(r.choices("ab ", k=9000))
    codes, at = repeats.symbols(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), False)
    unit = repeats.Unit(False, 20, 6)
    whole = repeats.anchors(codes, at, unit)
    monkeypatch.setattr(repeats, "SLAB", 700)
    import pyarrow as pa

    parts = [s for _, s in repeats.pieces(pa.array([text]), unit)]
    assert len(parts) > 5
    assert np.concatenate([s.place for s in parts]).tolist() == whole.place.tolist()
    assert np.concatenate([s.contexts for s in parts]).tolist() == whole.contexts.tolist()


def test_automaton_matching_statistics():
    r = random.Random(6)
    rows = [[r.randint(0, 2) for _ in range(r.randint(0, 25))] for _ in range(12)]
    a = SuffixAutomaton()
    for n, row in enumerate(rows):
        a.add(row, [(n, i) for i in range(len(row))])
    a.finish()
    for row in rows:
        got = dict(a.statistics(row, 4))
        want = {i: min((n, j) for n, x in enumerate(rows) for j in range(3, len(x)) if x[j - 3 : j + 1] == row[i - 3 : i + 1]) for i in range(3, len(row))}
        assert got == want


def test_hashes_in_blocks(monkeypatch):
    from granary.llm import common

    data = np.frombuffer(b" ".join(b"w%d" % (i % 50) for i in range(3000)), np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]), ~common.SPACE)
    whole = common.span_hashes(data, starts, ends)
    monkeypatch.setattr(common, "BLOCK", 100)
    assert (common.span_hashes(data, starts, ends) == whole).all() and len(set(whole.tolist())) == 50


def test_wide_windows_and_hot_anchors(spark):
    """Windows of over 255 symbols, with few spans a shard."""
    r = random.Random(7)
    base = "".join(r.choices("ab", k=3000))
    rows = [(i, base[: r.randint(0, 900)] + r.choice("xyz") + base[r.randint(0, 900) :]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 400, lambda t: list((t or "").encode()), bytes)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.kept_sha256, x.n_spans) for x in deduplicate_bytes(df, 400, 2).collect()}
    assert got == want


def test_radix_order_is_byte_order():
    from granary.llm.suffixes import byte_ranks, radix_passes

    r = random.Random(8)
    data = bytes(r.choices([0, 97, 255], k=1500)) * 2
    rank, many = byte_ranks(np.frombuffer(data, np.uint8), 8)
    starts = np.arange(3000 - 20)
    group = radix_passes([rank[starts + o] for o in (0, 8, 12)], many)
    windows = [data[i : i + 20] for i in starts]
    same = {w for w in windows if windows.count(w) > 1}
    shared = [i for i in starts if group[i] >= 0]
    assert {windows[i] for i in shared} == same and sorted(shared, key=lambda i: (group[i], i)) == sorted(shared, key=lambda i: (windows[i], i))


def test_very_long_text_and_odd_columns(spark):
    long = " ".join(str(i) for i in range(150_000))
    df = spark.createDataFrame([(1, long, 1), (2, "x " + long, 2)], "doc_id long, text string, `a.b` int").selectExpr("*", "map('k', 1) as place", "3 as tag", "4 as h")
    assert sorted((r.doc_id, r.n_removed) for r in deduplicate_words(df).collect()) == [(1, 0), (2, 150_000)]
    assert sorted((r.doc_id, r.n_removed) for r in deduplicate_bytes(df).collect()) == [(1, 0), (2, len(long))]
