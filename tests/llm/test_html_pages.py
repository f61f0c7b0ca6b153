"""Pages written by hand, of makes that no generator of the models writes just so."""

import pytest

from granary.llm import html

LONG = "The council met on Tuesday evening to discuss the new bridge, which has been planned for more than ten years now."
MORE = "Residents of the eastern bank said that the present crossing is too narrow, and that lorries should not use it."
LAST = "A decision is expected in spring; until then, both proposals can be read in the library."
LINKS = '<a href="/">Home</a> | <a href="/news">News</a> | <a href="/sport">Sport</a> | <a href="/about">About us</a>'

PAGES = {
    "table layout": (f"<html><body bgcolor=#ffffff><table width=100%><tr><td colspan=2><font size=6>The Valley Post</font></td></tr><tr><td width=120 valign=top><a href=/>Home</a><br><a href=/n>News</a><br><a href=/l>Letters</a></td><td><h1>Bridge debate goes on</h1><p>{LONG}<p>{MORE}<p>{LAST}</td></tr><tr><td colspan=2><font size=1>&copy; 1999 The Valley Post. All rights reserved.</font></td></tr></table></body></html>", ["Bridge debate goes on", LONG, MORE, LAST]),
    "one cell of text": (f"<table><tr><td>{LONG} {MORE}<br><br>{LAST}</td></tr></table>", [f"{LONG} {MORE} {LAST}"]),
    "no body": (f"<p>{LONG}</p><p>{MORE}</p>", [LONG, MORE]),
    "one paragraph": (f"<p>{LONG}</p>", [LONG]),
    "only text": (f"{LONG} {MORE}", [f"{LONG} {MORE}"]),
    "header in the article": (f"<html><body><header><a href=/>Site</a></header><article><header><h1>Bridge debate</h1></header><p>{LONG}</p><p>{MORE}</p></article><footer>Copyright 2020</footer></body></html>", ["Bridge debate", LONG, MORE]),
    "main without article": (f"<body><nav>{LINKS}</nav><main><h1>Bridge debate</h1><p>{LONG}</p><h2>What comes next</h2><p>{LAST}</p></main><aside><h2>Related</h2><ul><li><a href=/1>Old bridge closed</a></li></ul></aside></body>", ["Bridge debate", LONG, "What comes next", LAST]),
    "divs without names": (f"<html><head><title>x</title></head><body><div>{LINKS}</div><div><div><h1>Bridge debate</h1><p>{LONG}</p><p>{MORE}</p><ul><li>First proposal: a wider bridge.</li><li>Second proposal: a tunnel.</li></ul></div></div><div>Copyright 2011 Valley Post. Powered by Press.</div></body></html>", ["Bridge debate", LONG, MORE, "First proposal: a wider bridge.", "Second proposal: a tunnel."]),
    "names that say nothing": (f'<body><div class="x1a"><a href=/>Valley</a></div><div class="q-77"><div class="css-9f"><h1>Bridge debate</h1></div><div class="css-2b"><p>{LONG}</p><p>{MORE}</p></div></div><div class="zz"><a href=/p>Privacy</a> <a href=/t>Terms of use</a></div></body>', ["Bridge debate", LONG, MORE]),
    "a post with comments": (f'<body><div id="header">Valley Blog</div><div id="content"><div class="post"><h2>Bridge debate</h2><div class="entry"><p>{LONG}</p><p>{LAST}</p></div></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>I agree with the tunnel, it is the better plan by far.</p></div></div></div><div id="sidebar"><ul><li><a href=/a>Archive</a></li></ul></div><div id="footer">&copy; Valley Blog</div></body>', ["Bridge debate", LONG, LAST]),
    "old list of a rule": (f"<HTML><BODY><H1>Bridge debate</H1><HR>{LONG}<P>{MORE}<HR><ADDRESS>Webmaster, all rights reserved</ADDRESS></BODY></HTML>", ["Bridge debate", LONG, MORE]),
    "a notice before": (f'<body><div class="cookie-banner"><p>We use cookies. <button>Accept</button></p></div><div role="main"><h1>Bridge debate</h1><p>{LONG}</p><blockquote>{MORE}</blockquote></div><form><input name=q><button>Search</button></form></body>', ["Bridge debate", LONG, MORE]),
    "nothing but links": (f"<body><nav>{LINKS}</nav><footer>Copyright 2020</footer></body>", []),
}


@pytest.fixture(scope="module")
def texts():
    models = html.train()
    return {name: [x for x in html.extract(page, models).split("\n\n") if x] for name, (page, _) in PAGES.items()}


def test_no_page_with_an_article_is_empty(texts):
    assert all(texts[name] for name, (_, want) in PAGES.items() if want)


def test_blocks_of_all_pages(texts):
    """Nine tenths of all blocks at least: found, and nothing else."""
    both = sum(len(set(texts[n]) & set(want)) for n, (_, want) in PAGES.items())
    either = sum(len(set(texts[n]) | set(want)) for n, (_, want) in PAGES.items())
    assert both / either >= 0.9, {n: (texts[n], want) for n, (_, want) in PAGES.items() if texts[n] != want}


@pytest.mark.parametrize("name", ["table layout", "no body", "header in the article"])
def test_pages_that_gave_nothing_once(texts, name):
    assert texts[name] == PAGES[name][1]
