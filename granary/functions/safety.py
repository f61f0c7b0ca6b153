"""Redaction of texts and keyed fields, prompt-injection scores, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import col, strip

#: Fixed patterns, in the order they apply, and what replaces them.
REDACTIONS = (
    (r"(?i)(api[_-]?key\s*[:=]\s*)([A-Za-z0-9_\-]+)", "$1***REDACTED***"),
    (r"sk-[A-Za-z0-9_\-]{10,}", "sk-***REDACTED***"),
    (r"\b1[3-9]\d{9}\b", "***PHONE***"),
    (r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "***EMAIL***"),
)


def redact_text(c: Column | str) -> Column:
    out = col(c)
    for pattern, mark in REDACTIONS:
        out = F.regexp_replace(out, pattern, mark)
    return out


#: Fixed names of fields that are never shown.
SENSITIVE_KEYS = ("access_token", "api_key", "apikey", "authorization", "cookie", "id_token", "password", "refresh_token", "secret", "token")


def is_sensitive_key(key: Column) -> Column:
    k = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    return k.isin(*SENSITIVE_KEYS) | k.rlike("(_api_key|_password|_secret)$")


def redact_map(fields: Column | str) -> Column:
    return F.transform_values(col(fields), lambda k, v: F.when(is_sensitive_key(k), F.lit("[REDACTED]")).otherwise(v))


#: Fixed signs of prompt injection, with their reasons. The last sign's capitals never occur in lower-cased text.
INJECTION_SIGNS = (
    ("试图覆盖系统提示", r"忽略.*指令|ignore previous instructions|forget previous instructions"),
    ("试图获取敏感信息", r"显示.*system prompt|输出.*系统提示|隐藏提示词|泄露.*api[_ -]?key|show your hidden prompt"),
    ("试图越权执行", r"你现在是开发者|开发者模式|系统管理员|切换为系统角色|pretend to be system"),
    ("疑似提示词注入结构", r"<system>|</system>|```system|BEGIN_SYSTEM_PROMPT"),
)
#: Fixed words that add a point.
SENSITIVE_WORDS = ("api_key", "password", "secret", "token")


def injection_check(c: Column | str) -> Column:
    """score, blocked (3 points or more) and reasons of a user's text."""
    t = F.lower(strip(c))
    word = F.lit(False)
    for w in SENSITIVE_WORDS:
        word = word | F.contains(t, F.lit(w))
    flags = [(reason, t.rlike(pattern), 2) for reason, pattern in INJECTION_SIGNS] + [("包含敏感词", word, 1)]
    score = sum((F.when(f, points).otherwise(0) for _, f, points in flags), F.lit(0))
    return F.struct(score.alias("score"), (score >= 3).alias("blocked"), F.array_compact(F.array(*[F.when(f, F.lit(r)) for r, f, _ in flags])).alias("reasons"))


#: Fixed classes of provider errors: words that tell them, name, whether a retry can help. The first that fits holds.
ERROR_CLASSES = (
    (("authentication", "api key", "unauthorized", "invalid_api_key"), "auth_error", False),
    (("rate limit", "429", "too many requests"), "rate_limit", True),
    (("timeout", "timed out", "deadline exceeded"), "timeout", True),
    (("connection", "network", "temporarily unavailable", "service unavailable", "connection reset", "dns", "connecterror", "overloaded"), "network_error", True),
    (("content policy", "safety", "moderation"), "safety_block", False),
    (("invalid request", "badrequest", "400", "context_length_exceeded", "invalid parameter", "unprocessable"), "request_error", False),
)


def classify_error(name: Column | str, message: Column | str) -> Column:
    t = F.lower(F.concat_ws(" ", col(name), col(message)))
    out = F.struct(F.lit("unknown_error").alias("category"), F.lit(False).alias("retryable"))
    for words, category, retryable in reversed(ERROR_CLASSES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, F.struct(F.lit(category).alias("category"), F.lit(retryable).alias("retryable"))).otherwise(out)
    return out
