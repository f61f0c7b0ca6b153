import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm.packing import OpenBins, WordTokenizer, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(1)
    pieces = ["The", "cat's", "I'LL", "don't,", "naïve.", "ÉTÉ", "ΟΔΟΣ", "İstanbul", "éa", "12,5%", "...", "!!", "日本語テキスト", "a\u0085b", "x y", "z\u001cq", "<|endoftext|>", "w<|startoftext|>x", "Ångström", "ǅ", "ﬁn", "́", "it's'", "²", "क्षि"]
    return [r.choice([" ", "\n", "\t "]).join(r.choices(pieces, k=r.randint(0, 60))) for _ in range(150)] + ["", " ", "\x00a", "a" * 3000]


def test_same_ids_as_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    w = WordTokenizer(PATH)
    all_texts = texts()
    for text, got in zip(all_texts, w.encode([x.encode() for x in all_texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def check_packed(rows, size, want):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= size
    for d, ids in want.items():
        got = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // size)))
        for r in got:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * size and r.length == min(size, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r.ids is None or list(r.ids) == part
    return len(places)


def test_same_ids_on_odd_strings():
    """Letters, marks that compose with them, capitals without a composed form, punctuation and odd spaces, at random."""
    t, w, r = Tokenizer.from_file(PATH), WordTokenizer(PATH), random.Random(6)
    letters = "TtHhWwYyJjEeAaNnKkSsIiσΣςİıßẞǅΩKÅéÉôÖŁ1٣½²ⅧアA<|>"
    marks = "\u0308\u0301\u0300\u0331\u030a\u030c\u0323\u0327\u0328\u0345\u0307\u20dd\u093c\u3099"
    others = " \n\t\u00a0\u0085\u2028.,'\"-’…!s"
    all_texts = ["".join(r.choice(r.choice((letters, letters, marks, others))) for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    all_texts += [c + m for c in map(chr, range(65, 0x250)) for m in marks]
    all_texts += [w[:i] + w[i:].upper() for w in ("don't", "we'll", "o'neil's", "naïve's") for i in range(len(w))]
    got = w.encode([x.encode() for x in all_texts])
    want = t.encode_batch(all_texts, add_special_tokens=False)
    assert [x for x, g, e in zip(all_texts, got, want, strict=True) if np.frombuffer(g, "<u4").tolist() != e.ids] == []


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="not a tokenizer"):
        WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_few_sequences_however_the_input_is_split(spark, parts):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices("a b c d e".split(), k=min(4000, int(r.lognormvariate(5.5, 1)))))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    t = Tokenizer.from_file(PATH)
    want = {d: [*t.encode(x, add_special_tokens=False).ids, 0] for d, x in rows}
    n = check_packed(pack(df, PATH, with_ids=False).withColumn("ids", F.lit(None)).collect(), 2048, want)
    assert n <= 1.02 * -(-sum(map(len, want.values())) // 2048) + 1


@pytest.mark.parametrize("size", [2048, 50])
def test_round_trip(spark, size):
    t = Tokenizer.from_file(PATH)
    rows = [(i, x, "z") for i, x in enumerate([*texts(), None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x, _ in rows}
    n = check_packed(pack(df, PATH, size=size).collect(), size, want)
    least = -(-sum(map(len, want.values())) // size)
    assert n <= 1.1 * least + 2


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a", 1, {"a": 1}), (1, "b", 2, {}), (1, "b", 2, {}), (2, "w " * 300_000, 3, None)], "doc_id long, text string, piece int, `a.b` map<string,int>")
    got = pack(df, PATH).collect()
    assert len(got) == 3 + 147 and sum(r.length for r in got) == 2 + 2 + 2 + 300_001
    assert pack(df.where("false"), PATH).count() == 0


def test_bins_stay_bounded_and_best_fit():
    r = random.Random(2)
    bins, open_, free = OpenBins(100, 5), {}, None
    for _ in range(3000):
        n = r.randint(1, 100)
        number, offset = bins.place(n)
        fitting = [s for s in open_.values() if s >= n]
        free = open_.pop(number, 100)
        assert offset == 100 - free and (free == min(fitting) if fitting else offset == 0)
        if free > n:
            if len(open_) == 5:
                open_.pop(min(open_, key=open_.get))
            open_[number] = free - n
        elif not fitting and len(open_) == 5:
            open_.pop(min(open_, key=open_.get))
        assert bins.count <= 5
        known = sorted(s for s, b in bins.by_space.items() for _ in b)
        assert len(known) == bins.count
        open_ = {b: s for s, bs in bins.by_space.items() for b in bs}
