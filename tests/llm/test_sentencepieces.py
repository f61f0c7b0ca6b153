import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from granary.llm import sentencepieces
from granary.llm.sentencepieces import PieceModel

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "x", " ", "  ", "\n", "▁", "é", "日", "🎉", "\x00", "\t", "<s>", "<unk>", "<0x41>", "the ", "ing", "1", ".", ",", "'", "\r", "　", "xxxx", "tion", "ﬁ", "A", "foo.", "bar, "]


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


def same(model, texts):
    want = model.library.encode(texts)
    assert [x.tolist() for x in model.encode(texts)] == want
    assert [model.decode(np.array(x, np.int64)).decode() for x in want] == model.library.decode(want)


def test_whole_texts(model):
    r = random.Random(1)
    same(model, ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["x" * k for k in range(120)] + [" " * k for k in range(60)] + ["\n" * k for k in range(9)])


def test_any_ids_decode(model):
    r = random.Random(2)
    ids = [[r.choice([0, 1, 2, 3, 5, 100, 200, 229, 232, 258, 259, 28705, 1318, r.randrange(32000), r.randrange(3, 259)]) for _ in range(r.randint(0, 12))] for _ in range(20000)]
    assert [model.decode(np.array(x, np.int64)).decode() for x in ids] == model.library.decode(ids)


def made(pieces, **how):
    """A model of the given (piece, score, kind), not trained."""
    m = sentencepiece_model_pb2.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *pieces]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type = 2
    m.trainer_spec.byte_fallback = how.get("fallback", False)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", how.get("dummy", True), how.get("squeeze", False)
    return m.SerializeToString()


SMALL = [(p, -k, 1) for k, p in enumerate(["ab", "bc", "abc", "▁a", "▁ab", "▁▁", "c▁", "ca", "▁", "a", "b", "c", "aa"])]


@pytest.mark.parametrize("how", [{}, {"dummy": False}, {"squeeze": True}, {"dummy": False, "squeeze": True}])
@pytest.mark.parametrize("more", [[], [("aab", -2.5, 5)], [("bb", 0, 4), ("bca", 0, 4)], [("cc", -1, 1), ("bb", -1, 1), ("bbc", 9, 5)]])
@pytest.mark.parametrize("crossing", [True, False])
def test_other_models(how, more, crossing):
    proto = made([p for p in SMALL if crossing or p[0] != "c▁"] + more, **how)
    m = PieceModel(proto=proto)
    r = random.Random(3)
    same(m, ["".join(r.choice("aabbcc  d") for _ in range(r.randint(0, 30))) for _ in range(500)])


def test_models_of_another_kind():
    m = sentencepiece_model_pb2.ModelProto.FromString(made(SMALL))
    m.trainer_spec.model_type = 1
    with pytest.raises(ValueError, match="merges"):
        PieceModel(proto=m.SerializeToString())


def test_a_wrong_agenda_is_found():
    m = PieceModel(PATH)
    m.made[:, 0] = m.made[::-1, 0]
    with pytest.raises(ValueError, match="other ids"):
        m.encode(["unquestionably"])


def test_long_texts_in_parts(model, monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(400)) for _ in range(40)] + ["x" * 500, " " * 500, ""]
    monkeypatch.setattr(sentencepieces, "BLOCK", 37)
    for t in texts:
        parts = model.blocks(t)
        ids = [x for p in model.encode(parts) for x in p.tolist()]
        assert ids == model.library.encode(t)
        assert b"".join(model.shown(np.array(ids, np.int64))).decode() == ",".join(map(str, ids))
        assert " ".join(model.library.decode(x.tolist()) for x in model.encode(parts)) == model.library.decode(ids)


def test_operator(spark):
    long = "word another. " * 100_000 + "z" * 3000
    texts = ["Hello  world\n foo", None, "", " ", long, "Hello  world\n foo", "日本語 🎉"]
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(texts)] + [(None, "no id", "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, `a.b` int").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r["doc_id"]: r for r in sentencepieces.encode(docs, PATH, whole=True).collect()}
    assert len(got) == 8
    for k, t, *_ in rows:
        ids = library.encode(t or "")
        r = got[k]
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ids, library.decode(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    thin = sentencepieces.encode(docs, PATH, with_ids=False)
    assert {r["doc_id"]: r["ids_sha256"] for r in thin.collect()} == {k: r["ids_sha256"] for k, r in got.items()}
    assert not sentencepieces.encode(docs.limit(0), PATH).collect()
    back = sentencepieces.decode(sentencepieces.encode(docs, PATH), PATH)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {k: r["decoded"] for k, r in got.items()}
    assert sentencepieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first()["decoded"] is None
