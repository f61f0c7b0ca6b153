import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import secrets
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_minhash import brute as near
from tests.llm.test_packing import check_packed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    say = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, say(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(260):
        kind = r.choice(["plain"] * 6 + ["copy", "copy", "toxic", "benchmark", "secret"])
        text = say(r.randint(30, 150))
        if kind == "copy" and docs:
            w = r.choice(docs)[1].split()
            w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        if kind == "toxic":
            text = " ".join(x for w in text.split() for x in ([w, "vile"] if r.random() < 0.2 else [w]))
        if kind == "benchmark":
            text += " " + r.choice(items)[1]
        if kind == "secret":
            text += ' password = "hunter2Xy9"'
        docs.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, 1, int("vile" in text)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, say(40), "en", "s", 1), (3, docs[3][1], "en", "s", docs[3][4])]
    d = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{d}/{name}.parquet")
    return d, items


def test_stages_against_brute_force(spark, tables):
    d, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, seen[-1], d).write.parquet(f"{d}/stage{i}")
        seen.append(spark.read.parquet(f"{d}/stage{i}"))
        assert seen[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in seen]
    toxic = [i for i, t in rows[0] if t and "vile" in t]
    assert len(set(toxic) & {i for i, _ in rows[1]}) <= 0.1 * len(toxic)
    assert len(rows[1]) >= 0.95 * (len(rows[0]) - len(toxic))
    groups = near([x for x in rows[1] if x[0] is not None], 5)
    assert sorted(x[0] for x in rows[2] if x[0] is not None) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert [x for x in rows[2] if x[0] is None] == [x for x in rows[1] if x[0] is None]
    bad = {(x[0], x[1]) for x in contaminated(rows[2], items, 13) if x[5]}
    assert bad and sorted(map(str, rows[3])) == sorted(str(x) for x in rows[2] if not any(x[0] == b[0] for b in bad))
    assert sorted(map(str, rows[4])) == sorted(str((i, t if t is None else secrets.redact(t))) for i, t in rows[3])
    assert not any(t and "hunter2Xy9" in t for _, t in rows[4]) and any(t and "[secret]" in t for _, t in rows[4])
    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows[4]}
    check_packed(corpus_pipeline.pack(spark, seen[-1], d).collect(), 2048, want)
    got = corpus_pipeline.run(spark, d).collect()
    check_packed(got, 2048, want)
    assert {r.doc_id for r in got} == set(want)


def test_stages_with_no_rows_and_other_columns(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 as tag", "2 as kept", "3 as id")
    for some in (docs.where("false"), docs.limit(20)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, some, d).collect()


def test_rows_that_share_an_id_but_not_a_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, None), (5, a), (5, a), (5, b), (3, c), (7, b + " more"), (9, a), (5, c), (None, a), (8, None)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [(5, None), (5, a), (5, b), (3, c), (None, a), (8, None)]))


def test_map_columns_and_dotted_names_in_every_stage(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "map('k', n_chars) as m", "n_chars as `a.b`", "array(map('k', lang)) as `c``d`")
    n = docs.where("doc_id = 3").count()
    assert n == 2
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        rows = out.collect()
        assert rows and (i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns)
        assert i != 1 or sum(r.doc_id == 3 for r in rows) == 1
