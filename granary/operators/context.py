"""Context packing: sources are deduplicated and ranked by windows, and fill sections under token budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.structured import risk_list
from granary.functions.vector import let

#: Fixed: the section of each source type, and its weight in ranking.
SECTION_OF = {"requirement": "requirement", "evidence": "evidence", "business_rule": "evidence", "api_doc": "evidence", "client_note": "evidence", "history": "history", "history_review": "history", "agent_summary": "agent_summary", "tool_result": "agent_summary", "other": "other"}
WEIGHT = {"business_rule": 95, "api_doc": 90, "evidence": 80, "client_note": 70, "agent_summary": 55, "tool_result": 45, "history_review": 35, "history": 30, "other": 10}
EVIDENCE = ("evidence", "business_rule", "api_doc", "client_note")
SECTIONS = ("evidence", "history", "agent_summary", "other")
#: Fixed: section titles, and what stands where there is no evidence.
TITLES = {"requirement": "Requirement", "evidence": "Evidence", "history": "History Summary", "agent_summary": "Agent Summary", "other": "Other Context"}
NO_EVIDENCE = "（无可用证据；只能基于 Requirement 判断，并应避免编造。）"


@dataclass(frozen=True)
class ContextPolicy:
    name: str
    token_budget: int
    sections: dict = field(default_factory=dict)
    compress: bool = True
    max_source_tokens: int | None = None
    min_compression_tokens: int = 48
    include: tuple[str, ...] | None = None


def _sections(requirement: int, evidence: int, history: int, agent: int, other: int) -> dict:
    return {"requirement": requirement, "evidence": evidence, "history": history, "agent_summary": agent, "other": other}


#: Fixed presets.
POLICIES = {
    p.name: p
    for p in (
        ContextPolicy("minimal", 500, _sections(500, 0, 0, 0, 0), False, None, include=("requirement",)),
        ContextPolicy("full_context", 2200, _sections(600, 1000, 300, 220, 80), False),
        ContextPolicy("balanced", 1400, _sections(450, 650, 160, 120, 20), True, 180),
        ContextPolicy("evidence_first", 1300, _sections(420, 760, 60, 50, 10), True, 180),
        ContextPolicy("tight_budget", 620, _sections(220, 300, 50, 40, 10), True, 90, 36),
        ContextPolicy("agent_summary_only", 800, _sections(420, 0, 0, 340, 40), True, 160, include=("agent_summary", "tool_result", "other")),
    )
}


def candidates(requests: DataFrame, sources: DataFrame, policy: ContextPolicy) -> DataFrame:
    """Sources with their request, section, standing within it (nth), and why they are out before any budget is spent (reason, else null).

    Of the sources of a request that share an id, and then of those that share a content (but for case and white space), the
    one that ranks best stays: by weight of its type, priority, score, id; of equals the earliest.
    """
    kind = F.col("source_type")
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])[kind], F.lit(0))
    section = F.coalesce(F.create_map(*[F.lit(x) for kv in SECTION_OF.items() for x in kv])[kind], F.lit("other"))
    requirement = F.when(T.strip(F.col("requirement")) == "", F.raise_error(F.lit("the requirement is blank")).cast("string")).otherwise(T.strip(F.col("requirement")))
    s = sources.withColumns({
        "section": section,
        "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        "standing": F.struct(weight.alias("w"), F.col("priority").alias("p"), F.coalesce("score", F.lit(0.0)).alias("s"), F.col("source_id").alias("i")),
        "same": F.lower(F.regexp_replace("content", rf"[{T.SPACE}]+", "")),
        "asked": kind.isin(*policy.include) if policy.include is not None else F.lit(True),
    })
    best = lambda *by: F.row_number().over(Window.partitionBy("request_id", *by).orderBy(F.desc("standing"), "place"))
    s = s.withColumn("of_id", best("asked", "source_id"))
    s = s.withColumn("lead", F.col("asked") & (F.col("of_id") == 1)).withColumn("of_content", best("lead", "same"))
    off = [name for name in SECTIONS if policy.sections.get(name, 0) <= 0]
    reason = F.when(~F.col("asked"), "source_type_excluded").when(F.col("of_id") > 1, "duplicate_source_id").when(F.col("of_content") > 1, "duplicate_content").when(F.col("section").isin(*off), "section_disabled")
    ranked = s.withColumn("reason", reason).withColumn("nth", best("section"))
    return ranked.join(requests.select("request_id", requirement.alias("requirement")), "request_id").drop("same", "asked", "of_id", "lead", "of_content", "standing")


def _shortened(parts: Column, text: Column, target: Column) -> Column:
    """The parts of a text with most of the wanted words, in their own order, until three quarters of the target are full."""
    by_hits = F.array_sort(F.transform(parts, lambda p, i: F.struct((-p["hits"]).cast("int").alias("h"), i.cast("int").alias("i"), p["tokens"].cast("long").alias("tokens"))))
    kind = "struct<room: bigint, kept: array<int>, full: boolean>"
    empty = F.struct(target.alias("room"), F.array().alias("kept"), F.lit(False).alias("full")).cast(kind)

    def taken(a: Column, p: Column) -> Column:
        fits = ~a["full"] & (p["tokens"] <= a["room"])
        room = F.when(fits, a["room"] - p["tokens"]).otherwise(a["room"])
        kept = F.when(fits, F.concat(a["kept"], F.array(p["i"]))).otherwise(a["kept"])
        return F.struct(room.alias("room"), kept.alias("kept"), (a["full"] | (target - room >= 0.75 * target)).alias("full")).cast(kind)

    def shown(kept: Column) -> Column:
        joined = F.array_join(F.transform(F.filter(parts, lambda _, i: F.array_contains(kept, i.cast("int"))), lambda p: p["text"]), "\n")
        start = F.regexp_replace(F.substring(text, F.lit(1), F.greatest(F.lit(40), 2 * target).cast("int")), rf"[{T.SPACE}]+$", "")
        return F.when(F.size(kept) > 0, joined).when(F.size(parts) > 0, F.concat(start, F.lit("..."))).otherwise(text)

    return let(F.aggregate(by_hits, empty, taken)["kept"], shown)


DECISIONS = "request_id string, place int, source_id string, source_type string, section string, status string, reason string, tokens int, content string, citation boolean, shown string"
#: Reasons that are known before any section is filled.
EARLY = ("source_type_excluded", "duplicate_source_id", "duplicate_content")
_ROOMS = (*SECTIONS, "requirement")
_STATE = f"struct<left: bigint, rooms: array<bigint>, out: array<struct<{', '.join(c.replace(' ', ': ') for c in DECISIONS.split(', ')[2:])}>>>"


def _decided(rows: Column, policy: ContextPolicy) -> Column:
    """Spends the budgets of one request on its sources, section by section, best first. A source is shown short or whole, whichever comes first that fits."""
    rooms = F.array(*[F.lit(policy.sections.get(name, 0)) for name in _ROOMS])
    start = F.struct((policy.token_budget - F.element_at(rows, 1)["requirement_tokens"]).alias("left"), rooms.alias("rooms"), F.array().alias("out")).cast(_STATE)
    names = F.array(*[F.lit(name) for name in _ROOMS])

    def spent(a: Column, r: Column) -> Column:
        at = F.array_position(names, r["section"]).cast("int")
        room = F.when(r["reason"].isNotNull(), F.lit(0)).otherwise(F.greatest(F.least(a["left"], F.element_at(a["rooms"], at)), F.lit(0))).cast("long")
        target = F.least(room, F.lit(policy.max_source_tokens)).cast("long") if policy.max_source_tokens else room
        may = F.lit(policy.compress) & (room > 0) & (r["tokens"] > target) & (target >= policy.min_compression_tokens)

        def placed(text: Column, block: Column) -> Column:
            n = F.greatest(F.lit(1), F.floor(F.length(block) / 2))
            short = F.coalesce(may & (n < r["tokens"]) & (n <= room), F.lit(False))
            fits = short | ((room > 0) & (r["tokens"] <= room))
            cost = F.when(short, n).when(fits, r["tokens"]).otherwise(0)
            status = F.when(fits, "included").otherwise("dropped")
            why = F.when(short, "compressed").when(fits, "whole").otherwise(F.coalesce(r["reason"], F.lit("token_budget_exceeded")))
            one = F.struct(r["source_id"], r["source_type"], r["section"], status, why, F.when(short, n).otherwise(r["tokens"]), F.when(short, text).otherwise(r["content"]), fits & r["source_type"].isin(*EVIDENCE), F.when(short, block).otherwise(r["shown"]))
            left = F.transform(a["rooms"], lambda x, i: F.when(i + 1 == at, x - cost).otherwise(x))
            return F.struct(a["left"] - cost, left, F.concat(a["out"], F.array(one.cast(_STATE[_STATE.index("out: array<") + 11 : -2])))).cast(_STATE)

        text = F.when(may, _shortened(r["parts"], r["content"], target))
        return let(text, lambda t: let(F.struct(t.alias("t"), T.strip(F.concat(r["short_head"], F.lit("\n"), t)).alias("b")), lambda x: placed(x["t"], x["b"])))

    return F.aggregate(rows, start, spent)["out"]


def build_contexts(requests: DataFrame, sources: DataFrame, policy: ContextPolicy) -> DataFrame:
    """A decision for every source of every request: request_id, place, source_id, source_type, section, status, reason, tokens, content, citation, shown.

    requests: request_id, requirement; sources: request_id, place, source_id, source_type, title, content, priority, score,
    metadata (map). Places number what was left out before any budget was spent, then the sections in order. Budgets depend on
    what was taken before, so a request's candidates, the few that its routes give it, are sorted into an array and folded.
    """
    head = lambda metadata, content: T.context_block(F.col("source_id"), F.col("title"), F.col("source_type"), F.col("score"), metadata, content)
    c = candidates(requests, sources, policy).withColumn("shown", head(F.col("metadata"), F.col("content"))).withColumn("tokens", T.estimate_tokens("shown"))
    short = F.map_concat(F.map_filter("metadata", lambda k, _: k != "compressed"), F.create_map(F.lit("compressed"), F.lit("true")))
    words = T.keywords("requirement")
    parts = F.transform(T.segments("content"), lambda x: F.struct(x.alias("text"), T.segment_score(x, words).alias("hits"), T.estimate_tokens(x).alias("tokens")))
    early, turns = F.col("reason").isin(*EARLY) & F.col("reason").isNotNull(), F.array(*[F.lit(name) for name in _ROOMS])
    known = c.select(
        "request_id", F.when(early, 0).otherwise(F.array_position(turns, F.col("section"))).cast("int").alias("turn"), F.when(early, F.col("place")).otherwise(F.col("nth")).cast("int").alias("at"), "source_id", "source_type", "section", "reason", "content", "shown", "tokens",
        T.estimate_tokens("requirement").alias("requirement_tokens"), head(short, F.lit("")).alias("short_head"), F.when(F.col("reason").isNull(), parts).alias("parts"),
    )
    rows = known.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*known.columns[1:]))).alias("rows"))
    done = rows.select("request_id", F.posexplode(_decided(F.col("rows"), policy)).alias("at", "d"))
    return done.select("request_id", (F.col("at") + 1).alias("place"), "d.*")


def rendered_sections(decisions: DataFrame) -> DataFrame:
    """request_id, section, title, content, sources of what was included; evidence always has a row."""
    kept = decisions.where("status = 'included'").groupBy("request_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"]), "\n\n").alias("content"), F.count(F.lit(1)).alias("sources"))
    every = decisions.select("request_id").distinct().select("request_id", F.explode(F.array(*[F.lit(s) for s in SECTIONS])).alias("section"))
    titles = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    content = F.when(F.col("content").isNotNull(), F.col("content")).when(F.col("section") == "evidence", NO_EVIDENCE).otherwise("")
    return every.join(kept, ["request_id", "section"], "left").select("request_id", "section", titles[F.col("section")].alias("title"), content.alias("content"), F.coalesce("sources", F.lit(0)).alias("sources"))


def citation_membership(claims: DataFrame, allowed: DataFrame) -> DataFrame:
    """Claims with their status: candidate, or unknown_source. claims: request_id, risk_index, citation_index, source_id; allowed: source_id, and request_id unless all requests share the sources."""
    keys = [c for c in ("request_id", "source_id") if c in allowed.columns]
    ok = allowed.select(*keys).distinct().withColumn("known", F.lit(True))
    return claims.join(ok, keys, "left").withColumn("status", F.when(F.col("known"), "candidate").otherwise("unknown_source")).drop("known")


def trusted_answers(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """What an answer is worth: request_id, status (structured_invalid, unknown_citation or succeeded), error_stage, risks, citations, unknown (sources, sorted).

    answers: request_id, content (a model's text, read as a list of risks); allowed as for citation_membership. An answer is
    trusted only if it can be read and cites nothing but sources that its context held.
    """
    read = answers.withColumn("r", risk_list("content")).select("request_id", "r.*")
    cited = read.where("ok").select("request_id", F.posexplode("risks").alias("risk_index", "risk")).select("request_id", "risk_index", F.posexplode("risk.citations").alias("citation_index", "c"))
    judged = citation_membership(cited.select("request_id", "risk_index", "citation_index", "c.source_id"), allowed)
    counts = judged.groupBy("request_id").agg(F.count(F.lit(1)).alias("citations"), F.array_sort(F.collect_set(F.when(F.col("status") == "unknown_source", F.col("source_id")))).alias("unknown"))
    status = F.when(~F.col("ok"), "structured_invalid").when(F.size(F.coalesce("unknown", F.array())) > 0, "unknown_citation").otherwise("succeeded")
    return read.join(counts, "request_id", "left").select("request_id", status.alias("status"), "error_stage", F.when(F.col("ok"), F.size("risks")).otherwise(0).alias("risks"), F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))


def route_rank_text(contributions: Column) -> Column:
    return F.array_join(F.transform(contributions, lambda c: F.concat(c["route_name"], F.lit(":"), c["route_rank"].cast("string"))), ",")


def native_score_text(contributions: Column, higher: dict[str, bool], names: dict[str, str]) -> Column:
    """Each route's own score, and which way it is better. higher and names: by route."""
    of = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    way = F.transform(contributions, lambda c: F.concat(c["route_name"], F.lit("."), of(names)[c["route_name"]], F.lit("="), F.format_string("%.8f", c["native_score"]), F.when(of(higher)[c["route_name"]], "(higher)").otherwise("(lower)")))
    return F.array_join(way, ";")


def mapped_candidates(fused: DataFrame, chunks: DataFrame, config_ref: str, higher: dict[str, bool], names: dict[str, str]) -> DataFrame:
    """Fused candidates as context sources, with what became of each: outcome and reason. Excluded ones have no source.

    fused: as reciprocal_rank_fusion gives it; chunks: chunk_id, text, document_id, document_version, source_role,
    evidence_eligibility, locators (array). Earlier ranks have higher priority, and no score is made up.
    """
    e = F.col("evidence_eligibility")
    first = F.when(F.size("locators") > 0, F.element_at("locators", 1)).otherwise(F.raise_error(F.concat(F.lit("a candidate without source spans: "), "chunk_id")).cast("string"))
    c = fused.join(chunks, "chunk_id").withColumn("locators", F.array_distinct("locators")).withColumn("first", first)
    c = c.withColumn("source_type", F.when(e == "current_evidence", "evidence").when(e == "historical_context", "history_review").otherwise("other"))
    c = c.withColumn("outcome", F.when(F.col("source_type") == "other", "excluded").otherwise("mapped"))
    reason = F.when(F.col("source_type") == "evidence", "mapped_as_current_evidence").when(F.col("source_type") == "history_review", "mapped_as_history").otherwise("excluded_ineligible_source")
    said = {
        "chunk_id": F.col("chunk_id"), "document_id": F.col("document_id"), "document_version": F.col("document_version"), "source_role": F.col("source_role"), "evidence_eligibility": e,
        "source_locators": F.array_join("locators", " | "), "fusion_rank": F.col("fusion_rank").cast("string"), "rrf_score": F.format_string("%.8f", "rrf_score"),
        "route_ranks": route_rank_text(F.col("contributions")), "native_scores": native_score_text(F.col("contributions"), higher, names), "retriever_config_ref": F.lit(config_ref),
    }
    metadata = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)])
    title = F.concat(F.col("document_id"), F.lit("@"), F.col("document_version"), F.lit(" · "), F.col("first"))
    return c.select("query_id", F.col("chunk_id").alias("source_id"), "source_type", title.alias("title"), F.col("text").alias("content"), F.greatest(F.lit(1), 1000 - F.col("fusion_rank")).alias("priority"), F.lit(None).cast("double").alias("score"), metadata.alias("metadata"), F.col("fusion_rank").alias("place"), "outcome", reason.alias("reason"))


def rag_contexts(requests: DataFrame, mapped: DataFrame, policy: ContextPolicy, more: DataFrame | None = None) -> DataFrame:
    """Contexts of mapped candidates (request_id for query_id) and more sources, whose ids may not be candidates' too."""
    columns = ["request_id", "place", "source_id", "source_type", "title", "content", "priority", "score", "metadata"]
    sources = mapped.where("outcome = 'mapped'").withColumnRenamed("query_id", "request_id").select(columns)
    if more is not None:
        both = sorted(r.source_id for r in more.join(sources, ["request_id", "source_id"], "left_semi").select("source_id").distinct().limit(20).collect())
        if both:
            raise ValueError("sources that are candidates too: " + ", ".join(both))
        sources = sources.unionByName(more.withColumn("place", F.col("place") + 1_000_000).select(columns))
    return build_contexts(requests, sources, policy)
