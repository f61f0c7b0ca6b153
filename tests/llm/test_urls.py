import random
import re

import duckdb
import pandas as pd

from granary.llm import urls


def brute(rows, rounds=200, damping=0.85):
    def cut(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    pages = []
    for i, url, html in rows:
        host, path = cut(url)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        pages.append((i, host, path, max(fits, key=lambda r: len(r.text)) if fits else None, html))
    count, seeds, links = {}, {True: {}, False: {}}, set()
    for _, host, _, rule, html in pages:
        count[host] = count.get(host, 0) + 1
        if host:
            if rule:
                seeds[rule.allow][host] = seeds[rule.allow].get(host, 0) + 1
            for link in re.findall(r'href="([^"]*//[^"]+)"', html or ""):
                to = cut("http:" + link if link.startswith("//") else link)[0]
                if to and to != host:
                    links.add((host, to))
    score = {}
    for way in (True, False):
        edges = links if way else {(b, a) for a, b in links}
        out = {h: [b for a, b in edges if a == h] for h, _ in edges}
        rank = dict(seeds[way])
        for _ in range(rounds):
            new = dict(seeds[way])
            for h, x in rank.items():
                for to in out.get(h, []):
                    new[to] = new.get(to, 0) + damping * x / len(out[h])
            rank = new
        score[way] = rank
    done = []
    for i, host, path, rule, _ in pages:
        allow = rule.allow if rule else not (host and score[False].get(host, 0) - score[True].get(host, 0) > 0.5 * count[host])
        done.append((i, host, path, rule.text if rule else None, "allow" if allow else "block"))
    return sorted(done, key=str)


def test_against_brute_force_and_sql(spark):
    r = random.Random(1)
    hosts = ["www.Example.com", "example.com", "a.b.net", "b.net", "net", "x.org", "y.org", "z.org", "com", "q.de:80", "examplecom", "w.info"]
    rows = []
    for i in range(300):
        url = r.choice(["http://", "HTTPS://", "ftp://"]) + r.choice(hosts) + r.choice(["", "/", "/en/1", "/es/2", "/fr/", "/EN/", "?q=/en/", "#x", "/en/?a#b", "/en"])
        html = "".join(f'<a class="k" href="{r.choice(["/rel", "http://" + r.choice(hosts) + "/p", "//" + r.choice(hosts)])}">x</a>' for _ in range(r.randint(0, 3)))
        rows.append((i, url, html))
    rows += [(400 + i, "http://b.net/es/", "") for i in range(30)] + [(500, "http://spam.info/", '<a href="http://b.net/">b</a>')]
    rows += [(300, None, None), (301, "nothing", '<a href="http://x.org">'), (None, "http://x.org/", ""), (1, "://y.org/a://b/", None)]
    df = spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, html string, host string").repartition(3)
    got = sorted(((x.page_id, x.host, x.path, x.rule, x.verdict) for x in urls.judge(df).collect()), key=str)
    want = brute(rows)
    assert got == want and {w[4] for w in want if w[3] is None} == {"allow", "block"}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    sql = sorted(((None if pd.isna(x[0]) else int(x[0]), *x[1:]) for x in con.execute(urls.oracle()).fetchall()), key=str)
    assert sql == want


def test_a_long_chain_of_hosts_is_walked_to_its_end(spark):
    """Distrust reaches hosts that are many links away from a blocked one, and dies out with the distance."""
    rows = [(i, f"http://h{i}.org/", f'<a href="http://h{i + 1}.org/">x</a>') for i in range(30)] + [(1000 + i, "http://h30.org.net/es/", "") for i in range(40)]
    rows[29] = (29, "http://h29.org/", '<a href="http://h30.org.net/">x</a>')
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.verdict) for r in urls.judge(df).collect())
    assert got == sorted((i, v) for i, _, _, _, v in brute(rows))
    assert sum(v == "block" for i, v in got if i < 30) == 26
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert sorted((x[0], x[4]) for x in con.execute(urls.oracle()).fetchall()) == got


def test_ties_repeats_long_pages_and_odd_columns(spark):
    html = "<p>" + "x " * 300_000 + '<a href="http://b.net/">b</a>'
    rows = [(1, "http://b.net/es/", html, 1), (1, "http://b.net/es/", html, 1), (2, "http://s.org/", html, 2), (3, "http://half.org/", html + '<a href="http://other.org/">', 3), (4, "http://half.org/", "", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `rule.a` int").selectExpr("*", "map('a', 1) as trust", "'x' as verdict", "1 as rank")
    got = sorted((r.page_id, r.verdict) for r in urls.judge(df).collect())
    assert got == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "allow")]


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
