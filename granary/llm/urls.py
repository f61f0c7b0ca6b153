"""URL filters: rules by host and path, and trust that spreads over the link graph.

Pages that a rule judges are the seeds. Trust walks forward over links between hosts from hosts with allowed pages;
distrust walks backward from hosts with blocked pages, to those that link to them. Both are personalised PageRanks with
a share of the walks lost at every step, scaled to pages, so that without links a host has just the pages judged itself.
Rounds go on until no host's score changes by more than a small part of the threshold.
A host is blocked if its distrust is greater than its trust by more than half of its pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]*//[^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    text: str  # host and path, as example.com/en/
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("com/", True), Rule("example.com/en/", False), Rule("www.example.com/en/", True), Rule("net/es/", False), Rule("net/fr/", False))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """pages with rule and rule_allows of the longest rule that fits, else null."""
    rule = allows = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        rule, allows = F.when(fits, r.text).otherwise(rule), F.when(fits, r.allow).otherwise(allows)
    return pages.withColumn("rule", rule.cast("string")).withColumn("rule_allows", allows.cast("boolean"))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between hosts: source, target. pages: host, html. Links without a host stay on their own."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))))
    links = pages.where("host != '' and html is not null").select(F.col("host").alias("source"), found.alias("link"))
    whole = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.select("source", host_of(whole).alias("target")).where("target != '' and target != source").distinct()


def host_scores(pages: DataFrame, tolerance: float = 0.001, damping: float = 0.85) -> DataFrame:
    """host, pages, trust, distrust, each exact to tolerance * damping / (1 - damping) of the host's pages or so. pages: host, html, rule_allows."""
    hosts = stored(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if("rule_allows").alias("allowed"), F.count_if(~F.col("rule_allows")).alias("blocked")))
    links = stored(host_links(pages))
    seeds = hosts.where("host != ''").select("host", F.explode(F.array(F.struct(F.lit(True).alias("forward"), F.col("allowed").cast("double").alias("seed")), F.struct(F.lit(False).alias("forward"), F.col("blocked").cast("double").alias("seed")))).alias("x")).select("host", "x.forward", "x.seed")
    rank = seeds.select("host", "forward", F.col("seed").alias("rank"))
    if links.take(1):
        both = links.select(F.col("source").alias("host"), F.col("target").alias("to"), F.lit(True).alias("forward")).unionByName(links.select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(False).alias("forward")))
        out = both.groupBy("host", "forward").agg(F.count(F.lit(1)).alias("links"))
        both = stored(both.join(stored(out), ["host", "forward"]))
        seeds = stored(seeds.where("seed > 0"))
        rank = seeds.select("host", "forward", F.col("seed").alias("rank"))
        size = stored(hosts.select("host", F.col("pages").alias("scale")))
        change = np.inf
        while change > tolerance:  # walks lose a share at every step, so changes shrink by that share a round at least
            walked = both.join(rank, ["host", "forward"]).groupBy(F.col("to").alias("host"), "forward").agg((F.sum(F.col("rank") / F.col("links")) * damping).alias("walked"))
            new = seeds.join(walked, ["host", "forward"], "full").select("host", "forward", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("walked", F.lit(0.0))).alias("rank"))
            new = stored(new.join(rank.withColumnRenamed("rank", "last"), ["host", "forward"], "left").join(size, "host", "left"))
            change = new.agg(F.max(F.abs(F.col("rank") - F.coalesce("last", F.lit(0.0))) / F.coalesce("scale", F.lit(1)))).first()[0] or 0.0
            rank = new.select("host", "forward", "rank")
    by_host = rank.groupBy("host").agg(F.sum(F.when(F.col("forward"), F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("forward"), 0.0).otherwise(F.col("rank"))).alias("distrust"))
    return hosts.select("host", "pages").join(stored(by_host), "host", "left").select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5, tolerance: float = 0.001, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), trust, distrust of every page.

    A rule decides where one fits; else the host's scores. rules is a list of the caller's, evaluated in one expression a
    row. A url that is null or has no :// has an empty host, which takes no part in the graph and is allowed. Links of
    hosts that have no pages themselves carry nothing on. A host whose distrust exceeds its trust by just the threshold is
    allowed. Very long pages give all their links. Rows with null or repeated ids are judged like any other.
    Other columns are ignored; no rows give no rows.
    """
    p = ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path")), rules)
    scores = stored(host_scores(p, tolerance, damping))
    verdict = F.when(F.coalesce("rule_allows", ~((F.col("host") != "") & (F.col("distrust") - F.col("trust") > threshold * F.col("pages")))), "allow").otherwise("block")
    return p.drop("html").join(scores, "host").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def oracle(rules: Sequence[Rule] = RULES, threshold: float = 0.5, rounds: int = 60, damping: float = 0.85) -> str:
    """DuckDB SQL for the rows of judge over pages."""
    cases = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}')"
    steps = "".join(
        f""",
r{i + 1} as materialized (select host, forward, coalesce(s.seed, 0) + coalesce(w.walked, 0) as rank from seeds s full join
  (select b.target as host, b.forward, sum(r.rank / b.links) * {damping} as walked from both_ways b join r{i} r on r.host = b.host and r.forward = b.forward group by all) w using (host, forward))"""
        for i in range(rounds)
    )
    return f"""
with u as (select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
p as (select *, case {" ".join(f"when {fits(r)} then '{r.text}'" for r in cases)} end as rule,
  case {" ".join(f"when {fits(r)} then {str(r.allow).lower()}" for r in cases)} end as rule_allows from u),
hosts as (select host, count(*) as pages, count(*) filter (rule_allows) as allowed, count(*) filter (not rule_allows) as blocked from p group by host),
links as (select distinct source, target from (select source, translate(regexp_extract(case when starts_with(link, '//') then 'http:' || link else link end, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as target
  from (select host as source, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]*//[^"''\\s>]+)', 1)) as link from p where host <> '')) where target <> '' and target <> source),
one_way as (select source as host, target, true as forward from links union all select target, source, false from links),
both_ways as (select *, count(*) over (partition by host, forward) as links from one_way),
seeds as (select * from (select host, true as forward, allowed::double as seed from hosts where host <> '' union all select host, false, blocked::double from hosts where host <> '') where seed > 0),
r0 as (select host, forward, seed as rank from seeds){steps},
scores as (select host, sum(case when forward then rank else 0 end) as trust, sum(case when forward then 0 else rank end) as distrust from r{rounds} group by host)
select page_id, p.host, path, rule, case when coalesce(rule_allows, not (p.host <> '' and coalesce(distrust, 0) - coalesce(trust, 0) > {threshold} * pages)) then 'allow' else 'block' end as verdict
from p join hosts using (host) left join scores using (host)"""
