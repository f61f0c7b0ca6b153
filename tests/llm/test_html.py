import random

import numpy as np
import pytest

from granary.llm import html
from granary.llm.boosting import BoostedTrees


@pytest.fixture(scope="module")
def models():
    return html.train(300)


def test_held_out_pages(models):
    r, same, both, either = random.Random(77), 0, 0, 0
    for _ in range(150):
        page, blocks = html.write_page(r)
        want = {t for v in html.parse(page) for _, t in v.texts if t in blocks}
        got = set(html.extract(page, models).split("\n\n")) - {""}
        same += got == want
        both += len(got & want)
        either += len(got | want)
    assert same / 150 > 0.9 and both / either > 0.97


def test_a_page(models):
    page = """<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
    <article><h1>A &amp; B</h1><p><b>One&nbsp;two.<br> Three &#233;<p>Four <a href="x">five</a>, six.</p><!-- gone --></article><footer>&copy; Site</footer></body>"""
    assert html.extract(page, models) == "A & B\n\nOne two. Three é\n\nFour five, six."
    assert html.extract(page[: page.index("six.")], models) == "A & B\n\nOne two. Three é\n\nFour five,"
    assert html.extract("", models) == ""


def test_decoding_has_no_contradictions():
    r = np.random.default_rng(1)
    nodes = html.parse("<div>a<div>b<p>c</p></div><div><p>d</p><p>e</p></div></div>" * 3)
    for _ in range(50):
        keep = r.random(len(nodes))
        kept = html.decode(nodes, keep, (1 - keep) * r.random(len(nodes)))
        assert len(kept) == len(nodes)
    assert html.decode(nodes, np.full(len(nodes), 0.9), np.full(len(nodes), 0.05)).all()
    assert not html.decode(nodes, np.full(len(nodes), 0.05), np.full(len(nodes), 0.9)).any()


def test_boosting_learns():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_rows(spark, models):
    df = spark.createDataFrame([(1, "u", None, 1), (None, None, "", 2), (3, "u", "<article><p>Hi.</p></article>", 3)], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in html.main_text(df, models).collect()}
    assert got == {(1, "u", "", 0), (None, None, "", 0), (3, "u", "Hi.", 3)}
    assert html.main_text(df.where("false"), models).count() == 0


@pytest.mark.parametrize("page", ["<", "<p", "</", "<p><p></div></p>", "<!--", "<script>", "<a b='>", "a<b>c</b", "<" * 50, "<div>" * 3000 + "x"])
def test_broken_pages(models, page):
    html.extract(page, models)


def test_very_long_pages_repeats_and_odd_columns(spark, models):
    body = " ".join(f"word{i}" for i in range(40_000))
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1><p>{body}.</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string").selectExpr("*", "map('a', 1) as text", "2 as `a.b`", "3 as n_chars")
    got = html.main_text(df, models).collect()
    assert len(got) == 2 and got[0] == got[1] and body in got[0].text and got[0].n_chars == len(got[0].text)
