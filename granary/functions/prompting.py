"""Prompt columns: audits, context relevance, shown contexts, extractive answers, label alignment."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import col, one_line, preview, source_labels
from granary.functions.vector import CONCEPTS, let

#: Fixed signs of what a prompt has.
AUDIT = {
    "role": r"你是|你的角色|角色[:：]|扮演",
    "task": r"任务[:：]|请你|请根据|目标[:：]|请完成",
    "context": r"背景[:：]|上下文[:：]|输入[:：]|材料[:：]|需求[:：]|用户反馈[:：]",
    "constraints": r"要求[:：]|限制[:：]|约束[:：]|控制在|不要超过|必须",
    "output_format": r"输出格式[:：]|按以下格式|JSON|Markdown|分点输出|表格",
    "negative_constraints": r"不要|禁止|不得|不要输出|不要编造",
    "examples": r"(?s)示例|例子|few-shot|输入：.+输出：",
}
#: Fixed: what counts as a word of a question or a context.
TOKEN = r"[a-z0-9]+|[一-鿿]"
#: Fixed refusal.
NO_ANSWER = "我不知道。当前检索到的内容不足以支持这个问题。"


def audit_prompt(prompt: Column | str) -> Column:
    """What a prompt has, and how much of it (0 to 7)."""
    flags = {name: col(prompt).rlike(pattern) for name, pattern in AUDIT.items()}
    return F.struct(*[f.alias(n) for n, f in flags.items()], sum((f.cast("int") for f in flags.values()), F.lit(0)).alias("score"))


def relevance(question: Column | str, content: Column | str) -> Column:
    """0 to 0.98: concepts that both speak of, shared tokens, and a bonus for concept words that stand in both."""
    q, c = F.lower(one_line(question)), F.lower(one_line(content))

    def score(x: Column) -> Column:
        q, c = x["q"], x["c"]
        groups = []
        for _, words in CONCEPTS:
            table = F.array(*[F.lit(w) for w in words])
            asked = F.exists(table, lambda w: F.contains(q, w))
            told = F.exists(table, lambda w: F.contains(c, w))
            both = F.size(F.filter(table, lambda w: F.contains(q, w) & F.contains(c, w)))
            groups.append(F.struct(asked.cast("int").alias("asked"), (asked & told).cast("int").alias("met"), F.when(asked & told, both).otherwise(0).alias("words")))
        total = lambda name: F.aggregate(F.array(*groups), F.lit(0), lambda a, g: a + g[name])
        concept = F.when(total("asked") > 0, total("met") / total("asked")).otherwise(0.0)
        tokens = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)))
        lexical = let(tokens(q), lambda t: F.when(F.size(t) > 0, F.size(F.array_intersect(t, tokens(c))) / F.size(t)).otherwise(0.0))
        return F.when((q == "") | (c == ""), 0.0).otherwise(F.round(F.least(0.55 * concept + 0.20 * lexical + F.least(total("words") * 0.08, F.lit(0.24)), F.lit(0.98)), 3))

    return let(F.struct(q.alias("q"), c.alias("c")), score)


def shown_context(label: Column, filename: Column, index: Column, retrieval_score: Column, context_score: Column, content: Column, limit: int = 90) -> Column:
    return F.concat(F.format_string("[%s] filename=%s chunk=%s retrieval_score=%.3f context_score=%.3f\n", label, filename, index.cast("string"), retrieval_score, context_score), preview(content, limit, dots_inside=True))


def numbered_sources(results: Column) -> Column:
    """results: array of struct(source, title, content); (empty) if there is none."""
    lines = F.transform(results, lambda r, i: F.format_string("[来源%d] source=%s title=%s content=%s", i + 1, r["source"], r["title"], r["content"]))
    return F.when(F.size(results) > 0, F.array_join(lines, "\n")).otherwise("(empty)")


def context_blocks(context: Column | str) -> Column:
    """label and content of each [Sn] block."""
    found = F.regexp_extract_all(col(context), F.lit(r"(?ms)^\[S\d+\][^\n]*\n.*?(?=^\[S\d+\]|\z)"), F.lit(0))
    return F.transform(found, lambda b: F.struct(F.regexp_extract(b, r"^\[(S\d+)\]", 1).alias("label"), F.trim(F.regexp_replace(F.regexp_replace(b, r"^\[S\d+\][^\n]*\n", ""), r"^\s+|\s+$", "")).alias("content")))


def used_results(labels: Column, results: Column) -> Column:
    """Results that the labels name, in their order; all if they name none. labels like S2."""
    at = F.filter(F.transform(labels, lambda x: F.substring(x, 2, 9).cast("int")), lambda i: (i >= 1) & (i <= F.size(results)))
    return F.when(F.size(at) > 0, F.transform(at, lambda i: F.element_at(results, i))).otherwise(results)


def _answer(question: str, context: str) -> str:
    blocks = [(m[1], m[2].strip()) for m in re.finditer(r"(?ms)^\[(S\d+)\][^\n]*\n(.*?)(?=^\[S\d+\]|\Z)", context)]
    asked = " ".join(question.lower().split())
    words = dict.fromkeys([w for _, ws in CONCEPTS for w in ws if w in asked] + re.findall(TOKEN, asked))
    said = [(label, s.strip()) for label, body in blocks for s in re.split(r"(?<=[。！？.!?])\s+|\n+", body) if s.strip()]
    scored = [(sum(w in " ".join(s.lower().split()) for w in words), len(s), label, s) for label, s in said]
    picked: dict[str, str] = {}
    for overlap, _, label, s in sorted(scored, key=lambda x: x[:2], reverse=True):
        if overlap > 0 and label not in picked and len(picked) < 2:
            picked[label] = s
    for label, _ in blocks[:2]:  # what is missing comes from the first blocks
        first = next((s for x, s in said if x == label), None)
        if label not in picked and first and len(picked) < min(2, len(blocks)):
            picked[label] = first
    parts = [f"{s} [{label}]" for label, s in picked.items()]
    return ("根据检索到的内容，" + "；补充信息：".join(parts)) if parts else NO_ANSWER


def extractive_answer(question: Column | str, context: Column | str) -> Column:
    """A deterministic stand-in for a model: the best sentence of each of two blocks, with their labels."""

    def f(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([_answer(a or "", b or "") for a, b in zip(q, c, strict=True)])

    return F.pandas_udf(f, "string")(col(question), col(context))


def answer_labels(answer: Column | str) -> Column:
    return source_labels(answer)


def guarded_messages(system: str, user: Column | str) -> Column:
    """Messages in which the user's text is marked as data."""
    body = F.concat(F.lit("<user_input>\n"), col(user), F.lit("\n</user_input>"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))
